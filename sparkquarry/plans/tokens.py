"""Words without which a rule can't find anything in a file, in lower case: one of them must stand in it.

Only rules whose findings all lie in the file that holds the word are listed. One pass over each text tells which of all these words
it has (operators.prefilter); rules then leave out rows of other files by a test of bits.
"""

from __future__ import annotations

from .taint import VERBS
from .text_rules import PREFILTER

NEEDS: dict[str, tuple[str, ...]] = PREFILTER | {
    "EmptyExcept": ("except",), "HardcodedSecret": ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "accesskey", "access_key"), "FormatMismatch": ("format",),
    "SqlDangerousStatement": ("delete", "update", "truncate", "drop"), "MissingFinally": (".create",), "DebugOutput": ("outputdebugstring", "writeln", "codesite", "debugmsg"),
    "NestedTry": ("try",), "StringConcatInLoop": ("for", "while", "repeat"), "ParamByNameInLoop": ("parambyname",), "FieldByNameInLoop": ("fieldbyname",), "ReversedForRange": ("for",),
    "ReRaiseException": ("raise",), "RaiseOutsideExcept": ("raise",), "ExceptionTooGeneral": ("exception",), "ExceptInDestructor": ("destructor",), "DestructorWithoutInherited": ("destructor",),
    "SynchronizeInDestructor": ("destructor",), "ConstructorWithoutInherited": ("constructor",), "VirtualCallInCtor": ("constructor",), "InsecureRandom": ("random",),
    "ThreadFreeOnTerminateWithRef": ("freeonterminate",), "FloatEquality": ("double", "single", "extended", "real", "currency", "tdatetime"), "IntegerOverflow": ("int64",), "AssertWithSideEffect": ("assert",),
    "CaseStatementSize": ("case",), "DefaultCaseInCaseStatement": ("case",), "RaisingRawException": ("exception",), "TObjectListWithoutOwnership": ("tobjectlist",),
    "SQLInjection": VERBS, "CommandInjection": ("shellexecute", "createprocess", "winexec"), "DfmSqlFromUserInput": VERBS, "PathTraversal": ("file", "stream"), "DfmGodHandler": ("on",), "DfmTabOrderConflict": ("taborder",),
    "DfmActionMismatch": ("action",), "DfmMasterDetailUnlinked": ("mastersource",), "DfmDuplicateBinding": ("datafield",),
}

#: All of them, in the order of their bits.
ALL: tuple[str, ...] = tuple(sorted({word for words in NEEDS.values() for word in words if word}))
