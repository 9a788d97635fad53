"""Rules over lines and over whole blanked texts, as patterns.

LINE rules share one scan of the lines table and stay in the JVM. TEXT rules may span lines; they share one pass over texts.
A pattern reads one view: text as it is, code_ns without strings and comments, code_ks without comments, comment alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators import prefilter

W = r"(?<![A-Za-z0-9_])"
KEYWORDS = "begin|end|procedure|function|if|then|else|for|to|do|while|repeat|until|case|of|try|except|finally|var|const|type|class|uses|unit|interface|implementation|inherited|nil|not|and|or"

#: kind: (view, pattern that a line must have, pattern that it must not have)
LINE: dict[str, tuple[str, str, str]] = {
    "TabulationCharacter": ("text", r"\t", ""),
    "TooLongLine": ("text", r"^.{121,}", ""),
    "TrailingWhitespace": ("text", r"[^ \t][ \t]+$", ""),
    "LowercaseKeyword": ("code_ns", rf"\b(?!(?:{KEYWORDS})\b)(?i:{KEYWORDS})\b", ""),
    "NoSonarMarker": ("comment", r"(?i)NOSONAR", ""),
    "TodoComment": ("comment", r"(?i)\b(?:TODO|FIXME|HACK)\b|(?-i:\bXXX\b)", ""),
    "EmptyArgumentList": ("code_ns", r"[\w\]]\s*\(\s*\)", r"(?i)\b(?:procedure|function|constructor|destructor)\b"),
    "InlineAssembly": ("code_ns", r"(?i)\basm\b", ""),
    "GotoStatement": ("code_ns", r"(?i)\bgoto\s+\w", ""),
    "WithStatement": ("code_ns", r"(?i)\bwith\s+[\w(@^]", ""),
    "TrailingCommaArgList": ("code_ns", r",\s*\)", ""),
    "DigitGrouping": ("code_ns", r"(?<![\w$.#])\d{5,}(?![\w.])", ""),
    "CommentedOutCode": ("comment", r"(?i)^\s*(?://|\{|\(\*)\s*(?:.*:=.*;|(?:begin|end;)\s*$|(?:procedure|function)\s+\w+.*;|if\b.*\bthen\b.*;|\w+(?:\.\w+)*\([^)]*\);)\s*(?:\}|\*\))?\s*$", r"^\s*///"),
    "UnitLevelKeywordIndent": ("code_ns", r"(?i)^\s+(?:unit\s+[\w.]+;|(?:interface|implementation|initialization|finalization)\s*$)", ""),
    "RedundantBoolean": ("code_ns", r"(?i)(?<![:<>])(?:=|<>)\s*(?:true|false)\b", r"(?i):\s*[\w.]+\s*=\s*(?:true|false)|^\s*\w+\s*=\s*(?:true|false)\s*;|\bdefault\b"),
    "ExplicitTObjectInheritance": ("code_ns", r"(?i)\bclass\s*\(\s*TObject\s*\)", ""),
    "GroupedDeclaration": ("code_ns", r"^\s*[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)+\s*:(?!=)", ""),
    "ExceptOnException": ("code_ns", r"(?i)\bon\s+\w+\s*:\s*Exception\s+do\b", ""),
    "SuperfluousSemicolon": ("code_ns", r";\s*;", r"(?i)\bfor\b"),
    "AssignedAndAssignedNil": ("code_ns", r"(?i)\bAssigned\s*\(\s*([\w.]+)\s*\)\s*\)?\s+and\s+\(?\s*\1\s*<>\s*nil\b|\b([\w.]+)\s*<>\s*nil\s*\)?\s+and\s+\(?\s*Assigned\s*\(\s*\2\s*\)", ""),
    "AvoidOut": ("code_ns", r"(?i)[(;]\s*out\s+[A-Za-z_]", ""),
    "RedundantParentheses": ("code_ks", r"\(\([ \t]*(?:[A-Za-z_]\w*|\$?\d\w*|'(?:[^']|'')*')[ \t]*\)\)(?![.\[(])", ""),
    "PointerName": ("code_ns", r"^\s*(?!P[A-Z_])\w+\s*=\s*\^\s*\w", ""),
    "InterfaceName": ("code_ns", r"(?i)^\s*(?!(?-i:I[A-Z_]))\w+(?:<[^>]*>)?\s*=\s*interface\b", ""),
    "BeginEndRequired": ("code_ns", r"(?i)\b(?:then|else|do)\s+(?!begin\b|if\b|case\b|try\b|for\b|while\b|repeat\b|with\b|asm\b)[A-Za-z_]", r"(?i)\bon\b.*\bdo\b"),
    "TautologicalBoolExpr": ("code_ns", r"(?i)(?<![\w.\])+*/-])\(?([A-Za-z_][\w.]*(?:\[\w+\])?)\s*(?:=|<>|<=|>=|<|>|\band\b|\bor\b|\bxor\b)\s*\1(?![\w.\[(^+*/-])\s*(?:\)|then\b|do\b|;|$|and\b|or\b)", r"^\s*\w+\s*=\s*\w+\s*;"),
    "NilComparison": ("code_ns", r"(?i)[\w\])]\s*(?:=|<>)\s*nil\b", r"(?i):\s*[\w.^<>]+\s*=\s*nil\b|(?:^|[(;,])\s*const\b.*=\s*nil"),
    "BooleanPropertyNaming": ("code_ns", r"(?i)\bproperty\s+(?!(?:Is|Has|Can|Should|Was|Are|Do|Does|Use|Allow|Show|Auto|Enable|Visible|Enabled|Active|Checked|ReadOnly|Modified|Connected|Loaded|Empty|Eof|Bof|Value|AsBoolean)[A-Z_\d]?\w*\b)\w+\s*:\s*(?:Boolean|LongBool|WordBool|ByteBool)\b", ""),
    "HttpInsteadOfHttps": ("code_ks", r"(?i)'http://(?!localhost\b|127\.0\.0\.1|\[?::1|schemas?\.|www\.w3\.org)[^'\s]+", ""),
    "AttributeIgnoreWithoutReason": ("code_ks", r"(?i)^\s*\[\s*Ignore\s*(?:\(\s*(?:'')?\s*\))?\s*\]", ""),
    "AttributeCategoryWithoutString": ("code_ks", r"(?i)^\s*\[\s*Category\s*(?:\(\s*\))?\s*\]", ""),
    "BoolAlwaysTrue": ("code_ns", r"(?i)\b(?:Length\s*\([^()]*\)|\w[\w.]*\.(?:Count|Length))\s*>=\s*0(?![\d.])|(?<![\w.])0\s*<=\s*(?:Length\s*\(|\w[\w.]*\.(?:Count|Length)\b)", ""),
    "LengthUnderflow": ("code_ns", r"(?i)\b(?:Length\s*\([^()]*\)|High\s*\([^()]*\)|\w[\w.]*\.(?:Count|Length))\s*-\s*(?:[2-9]|\d{2,})\b", ""),
    "MoveSizeOfPointer": ("code_ns", r"\b(?i:Move|FillChar|CopyMemory|ZeroMemory|FillMemory)\s*\(.*(?i:SizeOf)\s*\(\s*P(?:[A-Z]\w*|ointer|Char)\s*\)", ""),
    "PointerArithmeticOnString": ("code_ns", r"(?i)\bP(?:Ansi|Wide)?Char\s*\([^()]*\)\s*[+-]\s*\w", ""),
    "StringFromPointer": ("code_ns", r"\b(?i:string|AnsiString|UTF8String|RawByteString|WideString)\s*\(\s*P[A-Z]?\w*\s*\)", ""),
    "PointerSubtraction": ("code_ns", r"(?i)\b(Cardinal|Integer|LongWord|LongInt)\s*\(\s*(?:@|P)\w+\s*\)\s*-\s*(?:Cardinal|Integer|LongWord|LongInt)\s*\(\s*(?:@|P)\w+\s*\)", ""),
    "InsecureCryptoAlgorithm": ("code_ks", r"(?i)'(?:MD4|MD5|SHA-?1|DES|3DES|RC2|RC4|TLS\s?v?1(?:\.[01])?|SSLv?[23](?:\.0)?)'|\b(?:THashMD5|THashSHA1|TIdHash(?:MessageDigest5|MD4|MD5|SHA1)|TDCP_(?:md5|sha1|des|rc4)|TCipher_(?:DES|RC4))\b", r"(?i)\b(?:HMAC|checksum|etag)\b"),
    "DisabledTlsVerification": ("code_ks", r"(?i)\bSecureProtocols\s*:=\s*\[\s*\]|\bIgnoreCertificateErrors\s*:=\s*True\b|\bOnVerifyPeer\s*:=\s*nil\b|\bVerifyMode\s*:=\s*\[\s*\]|\bSSLVersions?\s*:=\s*\[?\s*sslv(?:SSLv2|SSLv23|SSLv3|TLSv1)\b(?!_)|\b(?:SecureProtocols|Protocols)\s*:=\s*\[[^\]]*(?:SSL2|SSL3|TLS1)\b(?!_)|\bVerify(?:Peer|Host|Certificate)\s*:=\s*False\b", ""),
    "FormatLocaleHint": ("code_ks", r"(?i)\b(?:Format|FormatUtf8)\s*\(\s*'[^']*%\d*\.\d+[fFgGnN][^']*'", r"(?i)FormatSettings|\bFS\b"),
    "HardcodedPath": ("code_ks", r"'(?:[A-Za-z]:\\|\\\\[\w.]+\\|/(?:opt|home|usr|var|etc)/|~/)[^']*'", ""),
    "HardcodedString": ("code_ks", r"(?i)\.\s*(?:Caption|Hint|Text)\s*:=\s*'[^']*[A-Za-z]{2}[^']*'|\b(?:ShowMessage|MessageDlg|MessageBox)\s*\(\s*'[^']*[A-Za-z]{2}[^']*'", ""),
    "SourceNonAsciiIdentifier": ("code_ns", r"[^\x00-\x7F]*[A-Za-z_]*[\u00AA-\u024F\u0370-\u1FFF\u2C00-\uD7FF]\w*", ""),
}

ROUTINE = r"\b(?:procedure|function|constructor|destructor)\b"

#: kind: (view, pattern); found in whole texts, case ignored; the line of the match's first group, else of the match
TEXT: dict[str, tuple[str, str]] = {
    "EmptyInterface": ("code_ns", r"\w+\s*=\s*interface\b\s*(?:\(\s*[\w.<>, ]+\s*\))?\s*(?:\[\s*\])?\s*end\b"),
    "EmptyBlock": ("code_ns", r"\b(?:then|else|do)\s+(begin)\s+end\b"),
    "RedundantJump": ("code_ns", r"\b(Exit|Continue)\s*;\s*end\s*;(?=\s*(?:procedure|function|constructor|destructor|initialization|finalization|end\s*\.|class\b))|\b(Continue)\s*;\s*end\s*;\s*until\b"),
    "EmptyFinallyBlock": ("code_ns", r"\b(finally)\s+end\b"),
    "RedundantConditional": ("code_ns", r"\b(if)\b[^;]*?\bthen\s+([\w.\[\]]+)\s*:=\s*(?:True\s+else\s+\2\s*:=\s*False|False\s+else\s+\2\s*:=\s*True)\b"),
    "IfElseBegin": ("code_ns", r"\bend\s+(else)\s+(?!begin\b|if\b|case\b|try\b|\w+\s*:)[A-Za-z_]"),
    "FreeAndNilHint": ("code_ns", r"\b([A-Za-z_][\w.]*)\.Free\s*;\s*\1\s*:=\s*nil\b"),
    "EmptyOnHandler": ("code_ns", r"\b(on)\s+(?:\w+\s*:\s*)?[\w.]+\s+do\s*(?:;|begin\s*end\b|(?=end\b))"),
    "SetLengthAppendInLoop": ("code_ns", rf"\b(?:for|while|repeat)\b(?:(?!{ROUTINE})[\s\S]){{0,600}}?\b(SetLength)\s*\(\s*([\w.]+)\s*,\s*(?:Length\s*\(\s*\2\s*\)|High\s*\(\s*\2\s*\))\s*\+"),
    "UnpairedLock": ("code_ns", rf"\b((?:[\w.]+\.(?:Lock|Acquire)\s*;)|(?:EnterCriticalSection|TMonitor\.Enter|RTLeventWaitFor)\s*\([^()]*\)\s*;)(?!\s*try\b)(?:(?!\btry\b|{ROUTINE})[\s\S]){{0,200}}?\b(?:Unlock|Release|LeaveCriticalSection|TMonitor\.Exit)\b"),
    "LockWithoutTryFinally": ("code_ns", r"\b([\w.]+\.(?:Enter|Acquire|BeginWrite|BeginRead)|TMonitor\.Enter\s*\([^()]*\)|EnterCriticalSection\s*\([^()]*\))\s*;(?!\s*try\b)"),
    "WithMultipleTargets": ("code_ns", r"\b(with)\s+(?:[^,;{}()\[\]<>]|\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>)+,[^;{}]{1,200}\bdo\b"),
    "GetMemWithoutFreeMem": ("code_ns", rf"\b(GetMem|AllocMem|ReallocMem)\b(?:(?!\btry\b|{ROUTINE})[\s\S]){{0,400}}?\bFreeMem\b"),
    "AssertMessage": ("code_ns", r"(?<![\w.])(Assert)\s*\((?:[^(),;]|\((?:[^();]|\([^();]*\))*\))*\)\s*;"),
    "ThreadResumeDeprecated": ("code_ns", r"\b(\w*Thread\w*\.Resume)\b(?!\s*:=)"),
    "TThreadDestroyWithoutTerminate": ("code_ns", rf"(?<!Terminate;)\s(FreeAndNil\s*\(\s*\w*Thread\w*\s*\)|\w*Thread\w*\.Free\b)(?<!x)"),
    "EmptyVisibilitySection": ("code_ns", r"^\s*((?:strict\s+)?(?:private|protected|public|published))\s*(?=(?:(?:strict\s+)?(?:private|protected|public|published)\b|end\b))"),
    "AnonMethodCaptureLoopVar": ("code_ns", r"\bfor\s+(?:var\s+)?(\w+)\s*:=[^;]*?\bdo\b(?:(?!\b(?:end\s*;\s*end)\b)[\s\S]){0,400}?\b(?:procedure|function)\s*(?:\([^)]*\)\s*)?(?::\s*\w+\s*)?begin(?:(?!\bend\b)[\s\S])*?\b\1\b"),
    "AttributeTestFixtureWithoutTests": ("code_ns", r"(\[\s*TestFixture[^\]]*\])\s*\w+\s*=\s*class\b(?:(?!\[\s*Test|\bpublished\b)[\s\S])*?\bend\s*;"),
}

#: Words of which a text must have one before a pattern is tried on it, in lower case.
PREFILTER: dict[str, tuple[str, ...]] = {
    "EmptyInterface": ("interface",), "EmptyBlock": ("begin",), "RedundantJump": ("exit", "continue"), "EmptyFinallyBlock": ("finally",), "RedundantConditional": ("true",), "IfElseBegin": ("else",), "FreeAndNilHint": (".free",),
    "EmptyOnHandler": ("except",), "SetLengthAppendInLoop": ("setlength",), "UnpairedLock": ("lock", "acquire", "entercriticalsection", "tmonitor", "rtleventwaitfor"), "LockWithoutTryFinally": ("enter", "acquire", "beginwrite", "beginread"),
    "WithMultipleTargets": ("with",), "GetMemWithoutFreeMem": ("freemem",), "AssertMessage": ("assert",), "ThreadResumeDeprecated": (".resume",), "TThreadDestroyWithoutTerminate": ("thread",), 
    "EmptyVisibilitySection": ("private", "protected", "public", "published"), "AnonMethodCaptureLoopVar": ("for",), "AttributeTestFixtureWithoutTests": ("testfixture",),
}

FOUND = "file_id string, line int, kind string, detail string"


def line_test(kind: str, view: Column | None = None) -> Column:
    """Whether a line fits a rule of LINE, by its own view or by another column."""
    name, has, lacks = LINE[kind]
    text = F.col(name) if view is None else view
    return text.rlike(has) & ~text.rlike(lacks) if lacks else text.rlike(has)


def line_findings(lines: DataFrame, kinds: set[str], longest: int = 120) -> DataFrame:
    """(file_id, line, kind, detail) of all line rules wanted; one scan, one explode."""
    hits = [F.when(line_test(kind), F.lit(kind)) for kind in LINE if kind in kinds and kind != "TooLongLine"]
    if "TooLongLine" in kinds:
        hits.append(F.when(F.length("text") > longest, F.lit("TooLongLine")))
    if not hits:
        return lines.sparkSession.createDataFrame([], FOUND)
    return lines.select("file_id", F.col("line_no").alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("kind"), F.trim("text").alias("detail"))


def text_findings(texts: DataFrame, kinds: set[str], tokens: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, line, kind, detail) of the rules over whole texts. A pattern is tried where a text's bits have one of its words; without bits
    of a word, everywhere. Texts that no pattern is for don't reach Python."""
    wanted = {k: v for k, v in TEXT.items() if k in kinds}
    known = {k: [tokens.index(w) for w in PREFILTER[k]] for k in wanted if k in PREFILTER and {*PREFILTER[k]} <= {*tokens}}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {k: (view, re.compile(p, re.I | re.M)) for k, (view, p) in wanted.items()}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                for kind, (view, pattern) in compiled.items():
                    if kind in known and not any(row.bits[i // prefilter.WORD] >> i % prefilter.WORD & 1 for i in known[kind]):
                        continue
                    code = getattr(row, view)
                    for m in pattern.finditer(code):
                        at = m.start(1) if pattern.groups and m.start(1) >= 0 else m.start()
                        out.append((row.file_id, code.count("\n", 0, at) + 1, kind, " ".join(m.group().split())))
            yield pd.DataFrame(out, columns=["file_id", "line", "kind", "detail"])

    source = texts.where(~F.lower("file_id").endswith(".dfm")).select("file_id", "code_ns", "code_ks", "bits")
    if {*known} == {*wanted}:
        source = source.where(prefilter.any_bit("bits", [i for places in known.values() for i in places]))
    return source.mapInPandas(run, FOUND)
