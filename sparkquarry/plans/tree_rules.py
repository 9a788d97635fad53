"""Rules over the syntax tree, tokens and form tables, as SQL.

Each gives (file_id, line, detail). Views: ast, tok, lines, ranges, texts, comp, prop of the corpus, the tables of derived(), and those of VIEWS.
What lies in a subtree comes from `inside`, which one sweep over a file's sorted nodes makes (operators.intervals), so joins have
equal keys only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators import flow, intervals, labels, references

from . import indexes

VIEWS = {
    "meth": "select *, lower(substring_index(name, '.', -1)) as short, lower(regexp_extract(name, '^(.*)[.][^.]*$', 1)) as owner from ast where kind = 'Method'",
    "decl": """select d.*, lower(d.name) as short, lower(regexp_replace(c.name, '<.*$', '')) as owner, c.kind as owner_kind, c.type_ref as base, c.mods as owner_mods
        from ast d join ast c on c.file_id = d.file_id and c.node_id = d.parent_id where d.kind = 'MethodDecl' and c.kind in ('Class', 'Record', 'Interface')""",
    "klass": "select *, lower(regexp_replace(name, '<.*$', '')) as short, lower(trim(split(regexp_replace(type_ref, '<.*$', ''), ',')[0])) as base from ast where kind = 'Class' and mods not like '%;forward%'",
    "lits": r"""select file_id, node_id, line, explode(regexp_extract_all(concat_ws(' ', name, type_ref), "'((?:[^']|'')*)'", 1)) as lit from ast where kind in ('Assign', 'Call', 'Value', 'Raise', 'IfStmt')""",
    # names that the interface of a unit declares, and the words of its enumerations
    "declared": r"""select distinct lower(u.name) as unit, lower(w.name) as name from ast u join ast s on s.file_id = u.file_id and s.kind = 'Section' and s.name = 'interface'
        join inside i on i.file_id = s.file_id and i.outer_id = s.node_id join ast d on d.file_id = i.file_id and d.node_id = i.node_id and d.kind not in ('UsesItem', 'Uses', 'Section')
        lateral view explode(case when d.kind = 'EnumType' then array_append(regexp_extract_all(d.type_ref, '([A-Za-z_][A-Za-z0-9_]*)', 1), d.name) else array(substring_index(regexp_replace(d.name, '<.*$', ''), '.', -1)) end) w as name
        where u.kind = 'Unit' and w.name <> '' and not exists (select 1 from ast i where i.file_id = u.file_id and i.kind = 'Section' and i.name = 'initialization')""",
    "loops": "select * from ast where kind in ('ForStmt', 'WhileStmt', 'RepeatStmt')",
    "vars": "select * from ast where kind in ('LocalVar', 'Param')",
    "pv": """select form_id, comp_id, max(case when lower(path) = 'datasource' then raw end) as datasource, max(case when lower(path) = 'datafield' then raw end) as datafield, max(case when lower(path) = 'dataset' then raw end) as dataset,
        max(case when lower(path) = 'mastersource' then raw end) as mastersource, max(case when lower(path) in ('masterfields', 'indexfieldnames') then nullif(trim(raw), '') end) as masterfields,
        max(case when lower(path) = 'action' then raw end) as action, max(case when lower(path) = 'onclick' then raw end) as onclick, max(case when lower(path) = 'taborder' then try_cast(raw as int) end) as taborder,
        max(case when lower(path) = 'visible' then lower(raw) end) as visible, max(case when lower(path) = 'required' then lower(raw) end) as required, max(case when lower(path) = 'fieldname' then raw end) as fieldname,
        max(case when lower(path) = 'password' then raw end) as password, max(case when lower(path) in ('connectionstring', 'params.strings', 'params') then raw end) as connection from prop group by form_id, comp_id""",
    "evt": "select p.form_id, p.comp_id, substring_index(p.path, '.', -1) as event, p.raw as handler, p.line, c.class as comp_class from prop p join comp c on c.form_id = p.form_id and c.comp_id = p.comp_id where p.kind = 'Ident' and substring_index(p.path, '.', -1) rlike '^On[A-Z]'",
    # a form and the unit beside it; the class of its root in any unit
    "form": "select c.form_id, regexp_replace(c.form_id, '(?i)[.]dfm$', '.pas') as unit_id, c.class, c.name, lower(c.class) as short from comp c where c.parent_id is null",
    "edges": "select file_id, short as child, base as parent from klass where base <> ''",
}

MEMBERS = """select d.file_id, d.owner, d.short, d.name, d.line from decl d where d.owner_kind = 'Class' and d.mods like '%;public;%' and d.mods not rlike ';(override|virtual|dynamic|abstract|message|class);'
    and d.type_ref not like 'constructor%' and d.type_ref not like 'destructor%'"""
#: Kinds of nodes whose subtrees rules ask for.
OUTER = ["Section", "Method", "IfStmt", "ForStmt", "WhileStmt", "RepeatStmt", "CaseStmt", "TryFinally", "TryExcept", "ExceptBlock", "OnHandler"]
#: Steps of calls that a constructor's helpers are followed.
HELPERS = 5


def derived(sql, ast: DataFrame, tok: DataFrame, name: str, keep) -> DataFrame:
    """A table that rules share, made by an operator. sql() reads the views.

    inside: (file_id, outer_id, node_id). mtok: identifiers with their innermost routine. refs: public members with where they are used.
    typed: names in routines with their resolved type. ctor_calls: constructors and the routines of their class that they call, up to HELPERS steps on.
    """
    if name == "inside":
        outer = ast.where(F.col("kind").isin(OUTER)).select("file_id", F.col("node_id").alias("lo"), F.col("last_pre").alias("hi"), F.col("node_id").alias("outer"))
        found = intervals.contained(outer, ast.select("file_id", F.col("node_id").alias("at"), F.col("node_id").alias("inner")), ["file_id"])
        return keep(found.select("file_id", F.col("outer").alias("outer_id"), F.col("inner").alias("node_id")), name)
    if name == "mtok":
        routines = ast.where("kind = 'Method'").select("file_id", F.col("line").alias("lo"), F.col("end_line").alias("hi"), F.col("node_id").alias("outer"))
        words = tok.where("kind = 'ident'").select("file_id", F.col("line").alias("at"), F.struct("seq", F.expr("lower(ltrim('&', value))").alias("word"), "line", "col").alias("inner"))
        return keep(intervals.contained(routines, words, ["file_id"], innermost=True, self_too=True).select("file_id", F.col("outer").alias("method_id"), "inner.*"), name)
    if name == "typed":
        # names that routines use, with the type that the innermost scope, their class or their unit declares
        spans = ast.where("kind = 'Method'").select("file_id", F.col("node_id").alias("method_id"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
        used = sql("select t.file_id, t.word as name, t.line as at, t.method_id as inner from mtok t").distinct()
        local = intervals.contained(indexes.local_scopes(ast, spans), used, ["file_id", "name"], innermost=True, self_too=True).select("file_id", "name", F.col("inner").alias("method_id"), F.col("outer.type").alias("local")).distinct()
        fields = sql("select distinct m.file_id, m.node_id as method_id, lower(f.name) as name, f.type_ref as field from meth m join klass k on k.file_id = m.file_id and k.short = m.owner join ast f on f.file_id = k.file_id and f.parent_id = k.node_id and f.kind = 'Field'")
        shared = sql("select file_id, lower(name) as name, max(type_ref) as shared from ast where kind = 'Var' and method_id is null group by 1, 2")
        names = used.select("file_id", "name", F.col("inner").alias("method_id")).distinct()
        out = names.join(local, ["file_id", "name", "method_id"], "left").join(fields, ["file_id", "name", "method_id"], "left").join(shared, ["file_id", "name"], "left")
        return keep(out.select("file_id", "method_id", "name", F.lower(F.coalesce("local", "field", "shared")).alias("type_ref")).where("type_ref is not null").distinct(), name)
    if name == "refs":
        uses = sql("select t.word, t.file_id as unit, coalesce(m.owner, '') as owner, coalesce(m.short = t.word and m.line = t.line, false) as heading from mtok t left join meth m on m.file_id = t.file_id and m.node_id = t.method_id")
        members = sql(MEMBERS).select("owner", "name", "line", F.col("short").alias("word"), F.col("file_id").alias("unit"))
        below = labels.descendants(sql("select child, parent from edges"), members.select(F.col("owner").alias("node"))).select(F.col("ancestor").alias("owner"), F.col("node").alias("descendant"))
        return keep(references.references(members, uses, keep(below, "below"), keep).withColumnRenamed("home", "file_id"), name)
    graph = "concat_ws('#', m.file_id, m.owner) as graph"
    starts = sql(f"select {graph}, 'x' as origin, m.short as node from meth m where m.type_ref = 'constructor' and m.owner <> ''")
    calls = sql(rf"select {graph}, m.short as a, lower(regexp_extract(c.name, '^(?:(?i:Self)[.])?(\\w+)\\s*(?:[(;]|$)', 1)) as b from ast c join meth m on m.file_id = c.file_id and m.node_id = c.method_id and m.owner <> '' where c.kind = 'Call'")
    known = sql(f"select distinct {graph}, m.short as b from meth m where m.type_ref not rlike '^(con|de)structor'")
    reached = flow.carried(starts, calls.join(known, ["graph", "b"], "left_semi"), steps=HELPERS)
    return keep(sql("select m.*, concat_ws('#', m.file_id, m.owner) as graph from meth m").join(reached.select("graph", F.col("node").alias("short")).distinct(), ["graph", "short"], "left_semi").drop("graph"), name)


DB = "'TFDQuery', 'TFDConnection', 'TFDTable', 'TFDCommand', 'TFDStoredProc', 'TFDTransaction', 'TADOQuery', 'TADOConnection', 'TADOTable', 'TADODataSet', 'TQuery', 'TTable', 'TDatabase', 'TSQLConnection', 'TSQLQuery', 'TSQLDataSet', 'TIBQuery', 'TIBDatabase', 'TIBTable', 'TIBTransaction', 'TClientDataSet', 'TZQuery', 'TZConnection', 'TUniQuery', 'TUniConnection', 'TOraQuery', 'TOraSession'"
INPUTS = "'TEdit', 'TMemo', 'TComboBox', 'TCheckBox', 'TRadioButton', 'TListBox', 'TDBEdit', 'TDBMemo', 'TDBComboBox', 'TDBCheckBox', 'TMaskEdit', 'TSpinEdit', 'TDateTimePicker', 'TRichEdit', 'TLabeledEdit', 'TDBGrid', 'TDBLookupComboBox'"
LEAKY = "TStringList|TList|TObjectList|TFileStream|TMemoryStream|TStringStream|TBitmap|TIniFile|TRegistry|TThread|TStream|TStringBuilder|TJSONObject|TXMLDocument|TFDQuery|TADOQuery|TQuery|TDictionary|TQueue|TStack|TStreamReader|TStreamWriter|TCriticalSection|TIdHTTP|THTTPClient|TPicture|TPngImage|TJPEGImage|TCollection|TZipFile"
SQLWORD = r"(?i)'\\s*(?:SELECT\\s|INSERT\\s+INTO\\s|UPDATE\\s|DELETE\\s+FROM\\s|MERGE\\s+INTO\\s|EXEC\\s|ALTER\\s+TABLE\\s|DROP\\s)"
#: Where texts for people go.
MESSAGE = "(?i:Caption|Hint|Title|Message|Msg|ErrorText|ShowMessage\\\\w*|MessageDlg|MessageBox|Log\\\\w*|Write(?:Ln)?|OutputDebugString\\\\w*|Raise\\\\w*)"
NOSTR = "regexp_replace({}, \"'(?:[^']|'')*'\", \"''\")"
FREE = r"concat('(?i)(?<![A-Za-z0-9_.])(?:', {0}, '[.](?:Free|Destroy|DisposeOf)|FreeAndNil *[(] *', {0}, ' *[)])')"


def word(name: str, text: str) -> str:
    """SQL: whether a text has a name as a whole word, case ignored."""
    return rf"{text} rlike concat('(?i)(?<![A-Za-z0-9_])', {name}, '(?![A-Za-z0-9_])')"


def _owned(kind: str, owner: str) -> str:
    """SQL: nodes of a kind (d) inside a node (a) selected by owner."""
    return f"ast d join {owner} a on a.file_id = d.file_id and d.node_id between a.node_id and a.last_pre and d.node_id > a.node_id and d.kind = '{kind}'"


AST: dict[str, str] = {
    "MemoryLeak": rf"""select a.file_id, a.line, concat(a.name, ' := ', a.type_ref) as detail from ast a join ast v on v.file_id = a.file_id and v.method_id = a.method_id and v.kind = 'LocalVar' and lower(v.name) = lower(a.name)
        join meth m on m.file_id = a.file_id and m.node_id = a.method_id
        left join made d on d.file_id = a.file_id and d.node_id = a.node_id
        where a.kind = 'Assign' and (a.type_ref rlike '^(?i)\\w+(<[^>]*>)?[.]Create\\w*( *[(] *(?!Self|A?Owner|Application).*[)]| *[(] *[)]|)$' and (a.type_ref rlike '^(?i)({LEAKY})\\b' or lower(regexp_extract(a.type_ref, '^(\\w+)', 1)) in (select class from leaky)) or d.node_id is not null and v.type_ref rlike '^(?i)({LEAKY})\\b') and lower(regexp_extract(a.type_ref, '^(\\w+)', 1)) not in (select class from spared)
        and not exists (select 1 from ast f join sinks s on f.name rlike concat('(?i)(?<![A-Za-z0-9_])', s.class, ' *[(]') where f.file_id = a.file_id and f.method_id = a.method_id and f.kind = 'Call' and {word('a.name', 'f.name')})
        and not exists (select 1 from ast f where f.file_id = a.file_id and f.method_id = a.method_id and f.kind in ('Call', 'Assign', 'Raise', 'Exit') and f.node_id <> a.node_id
          and (f.name rlike {FREE.format('a.name')} or f.kind = 'Assign' and f.type_ref rlike concat('(?i)^', a.name, '$') or f.kind = 'Exit' and {word('a.name', 'f.type_ref')} or f.kind = 'Raise' and {word('a.name', 'f.name')}
            ))
        and not exists (select 1 from taken k where k.file_id = a.file_id and k.method_id = a.method_id and k.name = lower(a.name))""",
    "EmptyExcept": "select e.file_id, e.line, '' as detail from ast e left anti join ast c on c.file_id = e.file_id and c.parent_id = e.node_id where e.kind = 'ExceptBlock'",
    "SqlDangerousStatement": rf"""select a.file_id, a.line, a.t as detail from (select *, regexp_replace(concat_ws(' ', name, type_ref), "'\\s*[+]\\s*'", '') as t, lower(substring_index(name, '.', 1)) as who from ast where kind in ('Assign', 'Call')) a
        where a.t rlike "(?i)'\\s*(?:DELETE\\s+FROM\\s+\\S|UPDATE\\s+\\S+\\s+SET\\s|TRUNCATE\\s+TABLE\\s+\\S|DROP\\s+TABLE\\s+(?!IF\\s+EXISTS\\b)\\S)" and a.t not rlike '(?i)\\bWHERE\\b'
        and (a.kind = 'Assign' and a.name not rlike '{MESSAGE}$' or a.kind = 'Call' and a.name rlike '(?i)(ExecSQL|Execute\\w*|SQL[.](Add|Append)|[.]Open)\\s*[(]')
        and not exists (select 1 from ast n where n.file_id = a.file_id and n.method_id = a.method_id and n.node_id > a.node_id and n.kind in ('Assign', 'Call') and lower(substring_index(n.name, '.', 1)) = a.who
          and concat_ws(' ', n.name, n.type_ref) rlike "(?i)'\\s*(AND\\s|WHERE\\s)" and (n.name rlike '(?i)[.](Add|Append)\\w*\\s*[(]' or startswith(lower(n.type_ref), lower(n.name))))""",
    "HardcodedSecret": r"""select file_id, line, name as detail from ast where kind = 'Assign' and name rlike '(?i)(password|passwd|pwd|secret|token|api_?key|access_?key)$' and type_ref rlike "^'[^' ]{4,}'$" and type_ref not rlike "(?i)'(test|dummy|xxx+|\\*+|changeme|password|<[^>]*>|%s)'" """,
    "FormatMismatch": r"""select file_id, line, name as detail from (select *, regexp_extract(t, "(?i)\\bFormat *[(] *'((?:[^']|'')*)' *, *\\[((?:[^\\[\\]]|\\[[^\\]]*\\])*)\\]", 1) as fmt,
        regexp_replace(regexp_replace(regexp_extract(t, "(?i)\\bFormat *[(] *'((?:[^']|'')*)' *, *\\[((?:[^\\[\\]]|\\[[^\\]]*\\])*)\\]", 2), "'(?:[^']|'')*'", "''"), "[(][^()]*[)]|\\[[^\\]]*\\]", '') as args
        from (select file_id, line, name, concat_ws(' ', name, type_ref) as t from ast where kind in ('Assign', 'Call', 'Raise')) where t rlike "(?i)\\bFormat *[(] *'")
        where fmt <> '' and regexp_count(replace(fmt, '%%', ''), '%(?:\\d+:)?-?(?:\\d+|\\*)?(?:\\.(?:\\d+|\\*))?[dufegnmpsxDUFEGNMPSX]') <> case when trim(args) = '' then 0 else regexp_count(args, ',') + 1 end and fmt not rlike '%\\d+:|\\*'""",
    # Units of the corpus only: what others declare isn't known. Units that are used for their initialization are used.
    "UnusedUses": """select u.file_id, u.line, u.name as detail from ast u join (select distinct unit from declared) k on k.unit = lower(u.name)
        left anti join (select distinct t.file_id, n.unit from tok t join declared n on n.name = lower(ltrim('&', t.value)) where t.kind = 'ident') x on x.file_id = u.file_id and x.unit = lower(u.name) where u.kind = 'UsesItem'""",
    "MissingFinally": rf"""select a.file_id, a.line, a.name as detail from ast a join ast v on v.file_id = a.file_id and v.method_id = a.method_id and v.kind = 'LocalVar' and lower(v.name) = lower(a.name)
        where a.kind = 'Assign' and a.type_ref rlike '(?i)^T\\w+(<[^>]*>)?[.]Create\\b' and exists (select 1 from ast f where f.file_id = a.file_id and f.method_id = a.method_id and f.kind = 'Call' and f.name rlike {FREE.format('a.name')})
        and not exists (select 1 from ast t where t.file_id = a.file_id and t.method_id = a.method_id and t.kind = 'TryFinally')""",
    "DeadCode": """select file_id, line, detail from (select file_id, line, kind, name as detail, node_id, lag(kind) over w as before, lag(end_line) over w as before_line, lag(parent_id) over w as p from ast
        where kind in ('Assign', 'Call', 'IfStmt', 'ForStmt', 'WhileStmt', 'RepeatStmt', 'CaseStmt', 'TryFinally', 'TryExcept', 'Exit', 'Raise', 'Inherited', 'LabelMark', 'Block', 'Jump', 'Goto', 'WithStmt') window w as (partition by file_id, parent_id order by sibling_ix)) x
        where before in ('Exit', 'Raise') and kind <> 'LabelMark' and not exists (select 1 from ranges r where r.file_id = x.file_id and (r.start_line between x.before_line and x.line or r.end_line between x.before_line and x.line))""",
    "LongMethod": """select m.file_id, m.line, m.name as detail from meth m join inside i on i.file_id = m.file_id and i.outer_id = m.node_id join ast s on s.file_id = i.file_id and s.node_id = i.node_id join ast b on b.file_id = m.file_id and b.parent_id = m.node_id and b.kind = 'Block'
        where s.kind in ('Assign', 'Call', 'IfStmt', 'ForStmt', 'WhileStmt', 'RepeatStmt', 'CaseStmt', 'TryFinally', 'TryExcept', 'Exit', 'Raise', 'Inherited', 'Jump', 'Goto', 'WithStmt')
        group by m.file_id, m.node_id, m.line, m.name, b.line, b.end_line having b.end_line - b.line + 1 > :body_lines and count(*) > :statements""",
    "LongParamList": "select file_id, min(line) as line, name as detail from (select m.file_id, m.line, m.name, count(*) as n from ast m join ast p on p.file_id = m.file_id and p.parent_id = m.node_id and p.kind = 'Param' where m.kind in ('Method', 'MethodDecl') group by m.file_id, m.node_id, m.line, m.name) where n > :params group by file_id, name, n",
    "MagicNumber": r"""select file_id, line, n as detail from (select file_id, line, regexp_extract(regexp_replace(name, "'(?:[^']|'')*'", "''"), '(?:>=|<=|<>|>|<|=)\\s*(-?\\d+)\\b(?![.])', 1) as n from ast where kind = 'IfStmt') where n <> '' and not array_contains(split(:trivial, ','), n) and not (try_cast(n as bigint) between 1 and 1024 and bit_count(try_cast(n as bigint)) = 1)""",
    "DuplicateString": "select file_id, min(line) as line, concat(lit, ' x ', count(*)) as detail from lits where length(lit) >= 4 group by file_id, lit having count(*) >= 3",
    "DebugOutput": r"select a.file_id, a.line, a.name as detail from ast a where a.kind = 'Call' and a.name rlike '(?i)^(OutputDebugString[AW]?|Writeln|ShowMessage|CodeSite[.]Send\\w*|DebugMsg)\\b *[(]' and a.name not rlike '(?i)^ShowMessage' and not exists (select 1 from ranges r where r.file_id = a.file_id and upper(r.tag) like '%DEBUG%' and a.line between r.start_line and r.end_line)",
    "DeepNesting": """select file_id, min_by(line, (-d, node_id)) as line, concat('depth ', max(d)) as detail from (select n.file_id, n.method_id, n.node_id, n.line, 1 + count(a.node_id) as d from ast n left join inside i on i.file_id = n.file_id and i.node_id = n.node_id
        left join ast a on a.file_id = i.file_id and a.node_id = i.outer_id and a.method_id = n.method_id and a.kind in ('IfStmt', 'ForStmt', 'WhileStmt', 'RepeatStmt', 'CaseStmt')
        where n.kind in ('IfStmt', 'ForStmt', 'WhileStmt', 'RepeatStmt', 'CaseStmt') group by n.file_id, n.method_id, n.node_id, n.line) group by file_id, method_id having max(d) > :nesting""",
    # a comment between begin and end says that it is meant, unless it is code
    "EmptyMethod": """select m.file_id, m.line, m.name as detail from meth m join ast b on b.file_id = m.file_id and b.parent_id = m.node_id and b.kind = 'Block' where b.last_pre = b.node_id
        and not exists (select 1 from lines l where l.file_id = m.file_id and l.line_no between b.line and m.end_line and trim(l.comment) <> '' and l.code_ns not rlike '(?i)\\\\bend\\\\b' and l.comment not rlike ':=|;\\\\s*[})*]*\\\\s*$')""",
    "CyclomaticComplexity": rf"""select m.file_id, m.line, concat(m.name, ' ', 1 + sum(case when s.kind in ('IfStmt', 'ForStmt', 'WhileStmt', 'RepeatStmt', 'CaseArm', 'OnHandler') then 1 else 0 end) + sum(case when s.kind = 'IfStmt' then regexp_count({NOSTR.format('s.name')}, '(?i)\\b(?:and|or|xor)\\b') else 0 end)) as detail
        from meth m join ast s on s.file_id = m.file_id and s.method_id = m.node_id group by m.file_id, m.node_id, m.line, m.name
        having 1 + sum(case when s.kind in ('IfStmt', 'ForStmt', 'WhileStmt', 'RepeatStmt', 'CaseArm', 'OnHandler') then 1 else 0 end) + sum(case when s.kind = 'IfStmt' then regexp_count({NOSTR.format('s.name')}, '(?i)\\b(?:and|or|xor)\\b') else 0 end) > :cyclomatic""",
    "ConcatToFormat": rf"""select file_id, line, name as detail from ast where kind = 'Assign' and name not rlike '(?i)sql' and type_ref not rlike '(?i)^Format' and regexp_count(regexp_replace(regexp_replace({NOSTR.format('type_ref')}, '[(][^()]*[)]', ''), '\\[[^\\]]*\\]', ''), '[+]') >= 3 and {NOSTR.format('type_ref')} rlike '[A-Za-z_]' and type_ref rlike "'" """,
    "ReversedForRange": r"select file_id, line, type_ref as detail from ast where kind = 'ForStmt' and try_cast(regexp_extract(type_ref, '^(-?\\d+)\\s+(?i:to)\\s+(-?\\d+)$', 1) as bigint) > try_cast(regexp_extract(type_ref, '^(-?\\d+)\\s+(?i:to)\\s+(-?\\d+)$', 2) as bigint)",
    "SelfAssignment": "select a.file_id, a.line, a.name as detail from ast a where a.kind = 'Assign' and lower(a.name) = lower(a.type_ref) and (a.name rlike '^[Ff][A-Z]\\\\w*$' or exists (select 1 from vars v where v.file_id = a.file_id and v.method_id = a.method_id and lower(v.name) = lower(a.name)))",
    "VirtualCallInCtor": r"""select c.file_id, c.line, c.name as detail from ast c join ctor_calls m on m.file_id = c.file_id and m.node_id = c.method_id join decl d on d.file_id = c.file_id and d.owner = m.owner and d.mods rlike ';(virtual|dynamic|override|abstract);' and d.type_ref not rlike '^(con|de)structor'
        and lower(regexp_extract(c.name, '^(?:(?i:Self)[.])?(\\w+)\\s*(?:[(;]|$)', 1)) = d.short where c.kind = 'Call'""",
    "CanBeUnitPrivate": "select file_id, line, name as detail from refs where external = 0 and subclass = 0 and unit = 1",
    "CanBeProtected": "select file_id, line, name as detail from refs where external = 0 and subclass = 1 and unit = 0",
    "UnusedPublicMember": "select file_id, line, name as detail from refs where external = 0 and subclass = 0 and unit = 0 and self = 0",
    "CanBeStrictPrivate": "select file_id, line, name as detail from refs where external = 0 and subclass = 0 and unit = 0 and self = 1",
    "UnusedLocalVar": "select v.file_id, v.line, v.name as detail from ast v join meth m on m.file_id = v.file_id and m.node_id = v.method_id where v.kind = 'LocalVar' and not exists (select 1 from mtok t where t.file_id = v.file_id and t.word = lower(v.name) and t.line between m.line and m.end_line and not (t.line = v.line and t.col = v.col))",
    "UnusedParameter": """select p.file_id, p.line, p.name as detail from ast p join meth m on m.file_id = p.file_id and m.node_id = p.parent_id join ast b on b.file_id = m.file_id and b.parent_id = m.node_id and b.kind = 'Block'
        where p.kind = 'Param' and p.name not like '\\\\_%' and lower(p.name) <> 'sender' and b.last_pre > b.node_id
        and not exists (select 1 from decl d where d.file_id = m.file_id and d.owner = m.owner and d.short = m.short and d.mods rlike ';(virtual|dynamic|override|abstract|message|published);')
        and not exists (select 1 from ast i where i.file_id = m.file_id and i.method_id = m.node_id and i.kind = 'Inherited' and i.name = '')
        and not exists (select 1 from mtok t where t.file_id = p.file_id and t.word = lower(p.name) and t.line between b.line and b.end_line and not (t.line = p.line and t.col = p.col))""",
    "ConsecutiveSection": r"select file_id, line_no as line, w as detail from (select file_id, line_no, w, last_value(prev, true) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding) as before from (select file_id, line_no, lower(regexp_extract(code_ns, '(?i)^\\s*(const|type|var|threadvar|resourcestring)\\s*$', 1)) as w, case when code_ns rlike '(?i)^\\s*(const|type|var|threadvar|resourcestring)\\s*$' then lower(trim(code_ns)) when code_ns rlike '(?i)\\b(begin|procedure|function|constructor|destructor|implementation|interface|class|record|end|initialization|private|public|protected|published)\\b' then '-' end as prev from lines)) where w <> '' and w = before",
    "ClassPerFile": "select file_id, line, detail from (select file_id, line, name as detail, row_number() over (partition by file_id order by node_id) as rn from klass) where rn = 2",
    "LegacyInitializationSection": "select file_id, line, 'begin' as detail from ast s where kind = 'Section' and name = 'begin' and exists (select 1 from ast u where u.file_id = s.file_id and u.kind = 'Unit' and u.mods = 'unit')",
    "PublicField": "select file_id, line, name as detail from ast where kind = 'Field' and mods in ('public', 'published') and exists (select 1 from klass c where c.file_id = ast.file_id and c.node_id = ast.parent_id) and not (mods = 'published' and type_ref rlike '^T[A-Z]')",
    "NestedTry": "select distinct d.file_id, d.line, '' as detail from ast d join inside i on i.file_id = d.file_id and i.node_id = d.node_id join ast a on a.file_id = i.file_id and a.node_id = i.outer_id and a.method_id = d.method_id and a.kind in ('TryFinally', 'TryExcept') where d.kind in ('TryFinally', 'TryExcept')",
    "CaseStatementSize": "select c.file_id, c.line, concat(count(*), ' branches') as detail from ast c join ast a on a.file_id = c.file_id and a.parent_id = c.node_id and a.kind = 'CaseArm' and a.name <> 'else' where c.kind = 'CaseStmt' group by c.file_id, c.node_id, c.line having count(*) >= :case_branches",
    "EmptyFile": "select u.file_id, 1 as line, u.name as detail from ast u where u.kind = 'Unit' and u.mods = 'unit' and (select count(*) from ast s where s.file_id = u.file_id and s.kind = 'Section' and s.name in ('interface', 'implementation')) = 2 and not exists (select 1 from ast x where x.file_id = u.file_id and x.kind in ('Class', 'Record', 'Interface', 'Type', 'EnumType', 'PointerType', 'Const', 'Var', 'Method', 'MethodDecl'))",
    "TwiceInheritedCalls": "select file_id, max(line) as line, '' as detail from ast i where kind = 'Inherited' and not exists (select 1 from ranges r where r.file_id = i.file_id and i.line between r.start_line and r.end_line) group by file_id, parent_id having count(*) >= 2",
    "ConsecutiveVisibility": "select file_id, line, name as detail from (select file_id, line, name, row_number() over (partition by file_id, parent_id, name order by node_id) as rn from ast where kind = 'Visibility') where rn > 1",
    "ConstructorWithoutInherited": "select m.file_id, m.line, m.name as detail from meth m join klass k on k.file_id = m.file_id and k.short = m.owner and k.base not in ('', 'tobject') where m.type_ref = 'constructor' and m.mods not like '%;class;%' and not exists (select 1 from ast i where i.file_id = m.file_id and i.method_id = m.node_id and (i.kind = 'Inherited' or concat_ws(' ', i.name, i.type_ref) rlike '(?i)\\\\binherited\\\\b|^Create *[(]'))",
    "DestructorWithoutInherited": "select m.file_id, m.line, m.name as detail from meth m where m.type_ref = 'destructor' and m.mods not like '%;class;%' and not exists (select 1 from ast i where i.file_id = m.file_id and i.method_id = m.node_id and i.kind = 'Inherited') and not exists (select 1 from (select f.file_id, count_if(b.last_pre = b.node_id) as e, count(*) as n from meth f join ast b on b.file_id = f.file_id and b.parent_id = f.node_id and b.kind = 'Block' group by f.file_id) s where s.file_id = m.file_id and s.e >= 5 and s.e > 0.7 * s.n)",
    "NestedRoutine": "select n.file_id, n.line, n.name as detail from ast n join ast p on p.file_id = n.file_id and p.node_id = n.parent_id and p.kind = 'Method' where n.kind = 'Method'",
    "FieldName": "select f.file_id, f.line, f.name as detail from ast f join klass k on k.file_id = f.file_id and k.node_id = f.parent_id where f.kind = 'Field' and f.mods rlike 'private|protected' and f.name not rlike '^F[A-Z]'",
    "TypeName": "select file_id, line, name as detail from ast where kind in ('Class', 'Record') and mods not like '%;forward%' and name not rlike '^[TEIPR][A-Z_]'",
    "MethodName": "select m.file_id, m.line, m.name as detail from meth m where substring_index(m.name, '.', -1) rlike '^[a-z]' and m.mods not rlike ';(external|cdecl|stdcall|export);' and not exists (select 1 from (select file_id, count_if(substring_index(name, '.', -1) rlike '^[a-z]') as low from meth group by file_id) s where s.file_id = m.file_id and s.low >= 5)",
    "SynchronizeInDestructor": "select c.file_id, c.line, c.name as detail from ast c join meth m on m.file_id = c.file_id and m.node_id = c.method_id and m.type_ref = 'destructor' where c.kind = 'Call' and c.name rlike '(?i)^(\\\\w+[.])?Synchronize\\\\b'",
    "StringConcatInLoop": r"""select distinct a.file_id, a.line, a.name as detail from ast a join inside i on i.file_id = a.file_id and i.node_id = a.node_id join loops l on l.file_id = i.file_id and l.node_id = i.outer_id where a.kind = 'Assign' and a.type_ref rlike concat('(?i)^', regexp_replace(a.name, '([\\[\\]().^$*+?|\\\\{}])', '\\\\$1'), '\\s*[+]') and (a.type_ref rlike "'" or exists (select 1 from vars v where v.file_id = a.file_id and v.method_id = a.method_id and lower(v.name) = lower(a.name) and lower(v.type_ref) in ('string', 'ansistring', 'widestring', 'unicodestring')))""",
    "ParamByNameInLoop": r"select distinct a.file_id, a.line, a.name as detail from ast a join inside i on i.file_id = a.file_id and i.node_id = a.node_id join loops l on l.file_id = i.file_id and l.node_id = i.outer_id where concat_ws(' ', a.name, a.type_ref) rlike '(?i)\\w+[.]ParamByName *[(]' and a.kind in ('Assign', 'Call', 'IfStmt')",
    "FieldByNameInLoop": r"select distinct a.file_id, a.line, a.name as detail from ast a join inside i on i.file_id = a.file_id and i.node_id = a.node_id join loops l on l.file_id = i.file_id and l.node_id = i.outer_id where concat_ws(' ', a.name, a.type_ref) rlike '(?i)\\w+[.]FieldByName *[(]' and a.kind in ('Assign', 'Call', 'IfStmt')",
    "PublicMemberWithoutDoc": "select d.file_id, d.line, d.name as detail from decl d left join lines l on l.file_id = d.file_id and l.line_no = d.line - 1 where d.owner_kind = 'Class' and d.mods like '%;public;%' and d.short not in ('create', 'destroy') and trim(coalesce(l.comment, '')) = ''",
    "ExceptionName": "select file_id, line, name as detail from klass where (base = 'exception' or base rlike '^e[a-z]+(error|exception)$') and name not rlike '^E[A-Z_]'",
    "LocalConstantName": "select c.file_id, c.line, c.name as detail from ast c join ast m on m.file_id = c.file_id and m.node_id = c.parent_id and m.kind = 'Method' join ast v on v.file_id = c.file_id and v.parent_id = c.node_id and v.kind = 'Value' and v.name rlike '^-?[$0-9][0-9A-Fa-f._]*$' where c.kind = 'Const' and c.name not rlike '^[A-Z][A-Z0-9_]*$'",
    "MissingRaise": "select file_id, line, name as detail from ast where kind = 'Call' and name rlike '^(Exception|E[A-Z]\\\\w*)[.](?i:Create\\\\w*)\\\\b'",
    "RoutineResultUnassigned": f"""select m.file_id, m.line, m.name as detail from meth m join ast b on b.file_id = m.file_id and b.parent_id = m.node_id and b.kind = 'Block' where m.type_ref like 'function%' and b.last_pre > b.node_id
        and not exists (select 1 from ast x where x.file_id = m.file_id and x.node_id between b.node_id and b.last_pre and (x.kind in ('Exit', 'Raise', 'Asm') or x.kind = 'Assign' and (lower(x.name) rlike '^result\\\\b' or lower(x.name) rlike concat('^', m.short, '\\\\b')) or x.kind in ('Call', 'ForStmt', 'IfStmt', 'WhileStmt', 'RepeatStmt', 'Assign') and {word("'result'", "concat_ws(' ', x.name, x.type_ref)")} or x.kind = 'Inherited'))""",
    "ReRaiseException": "select r.file_id, r.line, r.name as detail from ast r join inside i on i.file_id = r.file_id and i.node_id = r.node_id join ast h on h.file_id = i.file_id and h.node_id = i.outer_id and h.kind = 'OnHandler' and h.name <> '' and lower(trim(r.name)) = lower(h.name) where r.kind = 'Raise'",
    "CastAndFree": "select file_id, line, name as detail from ast where kind = 'Call' and name rlike '^\\\\(?(T[A-Z]\\\\w*\\\\s*[(][^()]*[)]|\\\\w+\\\\s+as\\\\s+T\\\\w+\\\\))[.](?i:Free|Destroy|DisposeOf)$'",
    "InstanceInvokedConstructor": "select c.file_id, c.line, c.name as detail from ast c join vars v on v.file_id = c.file_id and v.method_id = c.method_id and lower(v.name) = lower(substring_index(c.name, '.', 1)) and v.type_ref not rlike '(?i)^(class of|T\\\\w*Class$)' where c.kind = 'Call' and c.name rlike '^\\\\w+[.](?i:Create)\\\\b'",
    "InheritedMethodEmpty": "select m.file_id, m.line, m.name as detail from meth m join ast b on b.file_id = m.file_id and b.parent_id = m.node_id and b.kind = 'Block' join ast i on i.file_id = b.file_id and i.parent_id = b.node_id and i.kind = 'Inherited' where b.last_pre = i.node_id and (i.name = '' or lower(regexp_extract(i.name, '^(\\\\w+)', 1)) = m.short and i.name not like '%:=%') and exists (select 1 from decl d where d.file_id = m.file_id and d.owner = m.owner and d.short = m.short and d.mods like '%;override;%')",
    "RaisingRawException": "select file_id, line, name as detail from ast where kind = 'Raise' and name rlike '(?i)^Exception([.]Create\\\\w*\\\\b|$)'",
    "DateFormatSettings": "select file_id, line, name as detail from ast where kind in ('Call', 'Assign') and concat_ws(' ', name, type_ref) rlike '(?i)(?<![A-Za-z0-9_.])(StrToDate|StrToTime|StrToDateTime|DateToStr|TimeToStr|DateTimeToStr|StrToFloat|FloatToStr|FormatFloat|FormatDateTime|StrToCurr|CurrToStr)(Def)? *[(]' and concat_ws(' ', name, type_ref) not rlike '(?i)FormatSettings|\\\\bFS\\\\b|Invariant'",
    "UnicodeToAnsiCast": "select file_id, line, concat_ws(' ', name, type_ref) as detail from ast where kind in ('Call', 'Assign') and concat_ws(' ', name, type_ref) rlike \"(?i)(?<![A-Za-z0-9_.])(AnsiString|RawByteString|ShortString) *[(] *(?!''|P)[A-Za-z_]\"",
    "CharToCharPointerCast": "select file_id, line, concat_ws(' ', name, type_ref) as detail from ast where kind in ('Call', 'Assign') and concat_ws(' ', name, type_ref) rlike \"(?i)(?<![A-Za-z0-9_.])P(Wide|Ansi)?Char *[(] *('(?:[^']|'')'|#[0-9]+|Chr *[(][^()]*[)]) *[)]\"",
    "IfThenShortCircuit": rf"select file_id, line, concat_ws(' ', name, type_ref) as detail from ast where kind in ('Call', 'Assign') and {NOSTR.format('''concat_ws(' ', name, type_ref)''')} rlike '(?i)\\b(?:Math[.]|StrUtils[.])?IfThen *[(][^;]*[(]'",
    "ExceptionTooGeneral": "select h.file_id, h.line, h.type_ref as detail from ast h where h.kind = 'OnHandler' and lower(h.type_ref) = 'exception' and not exists (select 1 from inside i join ast r on r.file_id = i.file_id and r.node_id = i.node_id where i.file_id = h.file_id and i.outer_id = h.node_id and (r.kind = 'Raise' or r.name rlike '(?i)log|HandleException|ShowException'))",
    "RaiseOutsideExcept": "select r.file_id, r.line, '' as detail from ast r where r.kind = 'Raise' and r.name = 'raise' and not exists (select 1 from inside i join ast e on e.file_id = i.file_id and e.node_id = i.outer_id where i.file_id = r.file_id and i.node_id = r.node_id and e.kind in ('ExceptBlock', 'OnHandler'))",
    "AbstractNotImpl": "select k.file_id, k.line, concat(k.name, '.', d.name) as detail from klass k join decl d on d.file_id = k.file_id and d.owner = k.base and d.mods like '%;abstract;%' where k.mods not like '%abstract%' and not exists (select 1 from decl o where o.file_id = k.file_id and o.owner = k.short and o.short = d.short) and not exists (select 1 from edges e where e.parent = k.short)",
    "LeakInConstructor": "select distinct m.file_id, m.line, m.name as detail from ast a join meth m on m.file_id = a.file_id and m.node_id = a.method_id and m.type_ref = 'constructor' join ast r on r.file_id = a.file_id and r.method_id = a.method_id and r.kind = 'Raise' and r.node_id > a.node_id where a.kind = 'Assign' and a.name rlike '^(Self[.])?F[A-Z]' and a.type_ref rlike '(?i)^T\\\\w+[.]Create\\\\b' and not exists (select 1 from ast t where t.file_id = a.file_id and t.method_id = a.method_id and t.kind = 'TryExcept') and not exists (select 1 from meth d where d.file_id = a.file_id and d.owner = m.owner and d.type_ref = 'destructor')",
    "IntegerOverflow": rf"select a.file_id, a.line, concat(a.name, ' := ', a.type_ref) as detail from ast a join typed v on v.file_id = a.file_id and v.method_id = a.method_id and v.name = lower(a.name) and v.type_ref in ('int64', 'uint64') where a.kind = 'Assign' and a.type_ref rlike '^\\w+\\s*[*]\\s*\\w+$' and a.type_ref not rlike '(?i)int64' and not exists (select 1 from typed o where o.file_id = a.file_id and o.method_id = a.method_id and o.type_ref in ('int64', 'uint64', 'double', 'extended', 'single', 'currency') and {word('o.name', 'a.type_ref')})",
    "GodClass": "select k.file_id, k.line, concat(k.name, ' ', count_if(x.kind = 'MethodDecl'), ' methods ', count_if(x.kind = 'Field'), ' fields') as detail from klass k join ast x on x.file_id = k.file_id and x.parent_id = k.node_id group by k.file_id, k.node_id, k.line, k.name having (count_if(x.kind = 'MethodDecl') > 20 or count_if(x.kind = 'Field' and x.mods not like '%;class') > 15) and not (count_if(x.kind = 'MethodDecl') > 0 and count_if(x.kind = 'MethodDecl') = count_if(x.kind = 'MethodDecl' and x.mods rlike ';(abstract|external);'))",
    "InsecureRandom": r"""select l.file_id, l.line_no as line, trim(l.text) as detail from lines l where l.code_ns rlike '(?i)(?<![\\w.])Random(Range|From)?\\s*([(]|;|[)])' and l.code_ns not rlike '(?i)\\b(function|procedure)\\b'
        and not exists (select 1 from tok t where t.file_id = l.file_id and t.kind = 'ident' and lower(t.value) = 'randomize')""",
    "ThreadFreeOnTerminateWithRef": r"""select distinct u.file_id, u.line, f.who as detail from (select *, lower(regexp_extract(name, '(?i)^([A-Za-z_]\\w*)[.]FreeOnTerminate$', 1)) as who from ast where kind = 'Assign' and lower(type_ref) = 'true') f
        join (select file_id, method_id, lower(substring_index(name, '.', 1)) as who, min(line) as line from ast where kind = 'Call' and name rlike '(?i)^[A-Za-z_]\\w*[.](Start|Resume)$' group by 1, 2, 3) s on s.file_id = f.file_id and s.method_id = f.method_id and s.who = f.who
        join ast u on u.file_id = f.file_id and u.method_id = f.method_id and u.line > s.line and u.kind in ('Call', 'Assign') and case when u.kind = 'Call' then u.name else u.type_ref end rlike concat('(?i)(?<![A-Za-z0-9_.])', f.who, '\\s*[.]\\s*(?!(Start|Execute|Resume)\\b)\\w') where f.who <> ''""",
    "FreeWithoutNil": rf"""select c.file_id, c.line, c.name as detail from (select *, lower(regexp_extract(name, '(?i)^(?:Self[.])?(\\w+)[.]Free$', 1)) as what from ast where kind = 'Call' and name rlike '(?i)^(Self[.])?\\w+[.]Free$') c
        join meth m on m.file_id = c.file_id and m.node_id = c.method_id join ast b on b.file_id = c.file_id and b.node_id = c.parent_id
        where c.what not in ('self', 'result', 'inherited') and not exists (select 1 from vars v where v.file_id = c.file_id and v.method_id = c.method_id and lower(v.name) = c.what)
        and not exists (select 1 from ast n where n.file_id = c.file_id and n.method_id = c.method_id and n.line > c.line and (n.kind = 'Assign' and lower(replace(lower(n.name), 'self.', '')) = c.what or n.name rlike concat('(?i)FreeAndNil *[(] *(Self[.])?', c.what, '\\b')))
        and c.node_id < m.last_pre""",
    "MultipleExit": "select m.file_id, m.line, concat(m.name, ' ', count(*)) as detail from meth m join ast x on x.file_id = m.file_id and x.method_id = m.node_id and x.kind = 'Exit' group by m.file_id, m.node_id, m.line, m.name having count(*) > 6",
    "LargeClass": "select k.file_id, k.line, k.name as detail from klass k left join (select file_id, owner, sum(end_line - line + 1) as n from meth group by file_id, owner) m on m.file_id = k.file_id and m.owner = k.short where k.end_line - k.line + 1 + coalesce(m.n, 0) > 500",
    "UnsortedUses": "select file_id, line, '' as detail from (select u.file_id, u.line, transform(array_sort(collect_list(struct(i.sibling_ix, lower(i.name) as name))), x -> x.name) as names from ast u join ast i on i.file_id = u.file_id and i.parent_id = u.node_id and i.kind = 'UsesItem' where u.kind = 'Uses' group by u.file_id, u.node_id, u.line) where names <> array_sort(names)",
    "MissingUnitHeader": """select u.file_id, u.line, '' as detail from ast u join ast i on i.file_id = u.file_id and i.kind = 'Section' and i.name = 'interface' where u.kind = 'Unit' and u.mods = 'unit'
        and not exists (select 1 from lines l where l.file_id = u.file_id and l.line_no > u.line and l.line_no < i.line and (trim(l.text) like '//%' or trim(l.text) like '{%' or trim(l.text) like '(*%'))""",
    "FloatEquality": r"select c.file_id, c.line, c.name as detail from ast c join typed v on v.file_id = c.file_id and v.method_id = c.method_id and v.type_ref in ('double', 'single', 'extended', 'real', 'currency', 'tdatetime') and c.name rlike concat('(?i)(?<![A-Za-z0-9_.<>:])', v.name, '\\s*(=|<>)\\s*(?!nil|\\d+(?![\\d.]))[\\w(]|(?<![<>:])(=|<>)\\s*', v.name, '(?![A-Za-z0-9_.(])') where c.kind in ('IfStmt', 'WhileStmt', 'RepeatStmt')",
    "ExceptInDestructor": "select r.file_id, r.line, r.name as detail from ast r join meth m on m.file_id = r.file_id and m.node_id = r.method_id and m.type_ref = 'destructor' where r.kind = 'Raise' and not exists (select 1 from inside i join ast t on t.file_id = i.file_id and t.node_id = i.outer_id where i.file_id = r.file_id and i.node_id = r.node_id and t.kind = 'TryExcept')",
    "BooleanParam": f"select distinct p.file_id, p.line, p.name as detail from ast p join meth m on m.file_id = p.file_id and m.node_id = p.parent_id and m.short not like 'set%' join ast i on i.file_id = p.file_id and i.method_id = m.node_id and i.kind = 'IfStmt' and {word('p.name', 'i.name')} where p.kind = 'Param' and lower(p.type_ref) = 'boolean'",
    "UnusedPrivateMethod": "select d.file_id, d.line, d.name as detail from decl d where d.owner_kind = 'Class' and d.mods rlike ';(strict )?private;' and d.mods not rlike ';(override|virtual|message);' and d.type_ref not rlike '^(con|de)structor' and not exists (select 1 from tok t left join meth m on m.file_id = t.file_id and m.owner = d.owner and m.short = d.short and t.line = m.line where t.file_id = d.file_id and lower(t.value) = d.short and t.line <> d.line and m.file_id is null)",
    "CanBeClassMethod": "select m.file_id, m.line, m.name as detail from meth m join decl d on d.file_id = m.file_id and d.owner = m.owner and d.short = m.short and d.owner_kind = 'Class' and d.mods not rlike ';(virtual|dynamic|override|abstract|message|class|published|static);' and d.type_ref not rlike '^(con|de)structor' join ast b on b.file_id = m.file_id and b.parent_id = m.node_id and b.kind = 'Block' and b.last_pre > b.node_id where not exists (select 1 from mtok t where t.file_id = m.file_id and t.method_id = m.node_id and t.line > m.line and (t.word in ('self', 'inherited') or t.word rlike '^f[a-z]' and t.word in (select lower(f.name) from ast f where f.kind = 'Field') or t.word in (select x.short from decl x) or t.word in (select lower(p.name) from ast p where p.kind in ('Property', 'Field'))))",
    "MissingOverride": "select d.file_id, d.line, concat(d.owner, '.', d.name) as detail from decl d join klass k on k.file_id = d.file_id and k.node_id = d.parent_id join decl p on p.file_id = d.file_id and p.owner = k.base and p.short = d.short and p.mods rlike ';(virtual|dynamic);' where d.mods not rlike ';(override|reintroduce|overload|class|virtual|dynamic);'",
    "ConstantReturn": r"""select m.file_id, m.line, m.name as detail from meth m join ast a on a.file_id = m.file_id and a.method_id = m.node_id and a.kind = 'Assign' and lower(a.name) = 'result' where m.type_ref like 'function%' group by m.file_id, m.node_id, m.line, m.name having count(*) >= 2 and count(distinct a.type_ref) = 1 and bool_and(a.type_ref rlike "^(-?[0-9.]+|'[^']*'|(?i:True|False|nil))$")""",
    "UnusedRoutine": "select m.file_id, m.line, m.name as detail from meth m join ast s on s.file_id = m.file_id and s.node_id = m.parent_id and s.kind = 'Section' and s.name = 'implementation' where m.owner = '' and m.short not in ('register', 'movenext', 'getenumerator', 'current') and m.type_ref not rlike '^(con|de)structor' and m.mods not rlike ';(external|export|message);' and not exists (select 1 from ast d where d.file_id = m.file_id and d.kind = 'MethodDecl' and lower(d.name) = m.short) and not exists (select 1 from tok t where t.file_id = m.file_id and lower(t.value) = m.short and t.line not between m.line and m.end_line)",
    "DefaultCaseInCaseStatement": "select c.file_id, c.line, c.name as detail from ast c left anti join ast a on a.file_id = c.file_id and a.parent_id = c.node_id and a.kind = 'CaseArm' and a.name = 'else' where c.kind = 'CaseStmt'",
    "AssertWithSideEffect": r"select file_id, line, name as detail from ast where kind = 'Call' and name rlike '(?i)^Assert *[(].*?\\b(?!Assigned|Length|High|Low|Ord|Supports|SameText|Pos|Copy|Trim|Abs|Odd|FileExists|DirectoryExists|IsNan|InRange|Assert|not|and|or|SizeOf|Format|Integer|Cardinal|NativeInt|Pointer|string|Is\\w*|Has\\w*|Can\\w*|Get\\w*|Contains\\w*)[A-Za-z_]\\w* *[(]|^Assert *[(] *(Delete|Remove|Add|Open|Close|Insert|Update|Save|Load|Write|Read|Execute|Next|Move|Set)\\w* *[,)]'",
    "ConstStringParameter": "select p.file_id, p.line, p.name as detail from ast p join ast m on m.file_id = p.file_id and m.node_id = p.parent_id and m.kind in ('Method', 'MethodDecl') where p.kind = 'Param' and p.mods = '' and lower(p.type_ref) in ('string', 'ansistring', 'widestring', 'unicodestring', 'utf8string', 'rawbytestring')",
    "VariantTypeMisuse": "select distinct v.file_id, v.line, v.name as detail from vars v join loops l on l.file_id = v.file_id and l.method_id = v.method_id where lower(v.type_ref) in ('variant', 'olevariant')",
    "TObjectListWithoutOwnership": "select distinct a.file_id, a.line, a.name as detail from ast a join ast c on c.file_id = a.file_id and c.method_id = a.method_id and c.kind = 'Call' and c.name rlike concat('(?i)^', a.name, '[.]Add *[(] *T\\\\w+[.]Create') where a.kind = 'Assign' and a.name rlike '^\\\\w+$' and a.type_ref rlike '(?i)^TList<T\\\\w+>[.]Create'",
    "CognitiveComplexity": rf"""select file_id, line, concat(name, ' ', sum(n)) as detail from (select m.file_id, m.node_id as mid, m.line, m.name, s.node_id, 1 + count_if(a.node_id is not null and not (e.kind <=> 'Else' and e.parent_id <=> a.node_id)) + max(case when s.kind = 'IfStmt' then regexp_count({NOSTR.format('s.name')}, '(?i)\\b(?:and|or|xor)\\b') else 0 end) as n
        from meth m join ast s on s.file_id = m.file_id and s.method_id = m.node_id and s.kind in ('IfStmt', 'ForStmt', 'WhileStmt', 'RepeatStmt', 'CaseStmt', 'ExceptBlock')
        left join ast e on e.file_id = s.file_id and e.node_id = s.parent_id
        left join inside i on i.file_id = s.file_id and i.node_id = s.node_id left join ast a on a.file_id = i.file_id and a.node_id = i.outer_id and a.method_id = s.method_id and a.kind in ('IfStmt', 'ForStmt', 'WhileStmt', 'RepeatStmt', 'CaseStmt', 'ExceptBlock')
        group by m.file_id, m.node_id, m.line, m.name, s.node_id) group by file_id, mid, line, name having sum(n) > 15""",
    "AttributeDuplicate": "select file_id, line, name as detail from (select file_id, line, name, row_number() over (partition by file_id, parent_id, name, next order by node_id) as rn from (select *, first_value(case when kind <> 'Attribute' then node_id end, true) over (partition by file_id, parent_id order by sibling_ix rows between 1 following and unbounded following) as next from ast) where kind = 'Attribute') where rn > 1",
    "AttributeMisalignment": r"select file_id, line_no as line, '' as detail from (select file_id, line_no, code_ns, lead(text) over (partition by file_id order by line_no) as after from lines) where code_ns rlike '^\\s*\\[\\s*[A-Z]\\w*(\\([^)]*\\))?\\s*\\]\\s*$' and trim(after) = ''",
    "ManagedResultUninit": rf"""select file_id, rd_line as line, name as detail from (select m.file_id, m.line, m.name, min(case when x.kind = 'Assign' and lower(x.name) = 'result' and not {word("'result'", 'x.type_ref')} or x.kind in ('Call', 'Inherited') and {word("'result'", 'x.name')} then x.node_id end) as w,
          min(case when (case when x.kind = 'Assign' then x.type_ref when x.kind in ('IfStmt', 'WhileStmt', 'Exit') then concat_ws(' ', x.name, x.type_ref) end) rlike '(?i)(?<![A-Za-z0-9_.])result(?![A-Za-z0-9_])' then x.node_id end) as rd,
          min_by(x.line, x.node_id) filter (where (case when x.kind = 'Assign' then x.type_ref when x.kind in ('IfStmt', 'WhileStmt', 'Exit') then concat_ws(' ', x.name, x.type_ref) end) rlike '(?i)(?<![A-Za-z0-9_.])result(?![A-Za-z0-9_])') as rd_line
          from meth m join ast x on x.file_id = m.file_id and x.method_id = m.node_id where m.type_ref rlike '(?i)^function:(string|ansistring|unicodestring|TArray<.*|array of .*|(?-i:I[A-Z])\\w*)$' group by m.file_id, m.node_id, m.line, m.name) where rd is not null and (w is null or rd <= w)""",
    "CompilerDirectiveScope": r"""select file_id, max_by(line_no, line_no) as line, name as detail from (select file_id, line_no, upper(regexp_extract(text, '(?i)[{][$](WARNINGS|HINTS|RANGECHECKS|OVERFLOWCHECKS|WARN \\w+)\\s+(ON|OFF)', 1)) as name, upper(regexp_extract(text, '(?i)[{][$](WARNINGS|HINTS|RANGECHECKS|OVERFLOWCHECKS|WARN \\w+)\\s+(ON|OFF)', 2)) as state from lines where text rlike '(?i)[{][$](WARNINGS|HINTS|RANGECHECKS|OVERFLOWCHECKS|WARN \\w+)\\s+(ON|OFF)')
        group by file_id, name having max_by(state, line_no) = 'OFF'""",
    "SourceUtf8NoBom": "select file_id, high_line as line, '' as detail from texts where bom = '' and valid_utf8 and non_ascii and lower(file_id) not like '%.dfm'",
    "SourceInvalidUtf8": "select file_id, high_line as line, '' as detail from texts where bom = 'utf8' and not valid_utf8",
    "SourceControlChar": "select file_id, control_line as line, '' as detail from texts where control_line is not null",
    "SourceAnsiNonAscii": "select file_id, high_line as line, '' as detail from texts where bom = '' and not valid_utf8 and non_ascii",
    "SourceUtf16": "select file_id, 1 as line, bom as detail from texts where bom like 'utf16%'",
    "SourceUtf32": "select file_id, 1 as line, bom as detail from texts where bom like 'utf32%'",
    "SourceBidiOverride": r"select file_id, min(line_no) as line, '' as detail from lines where text rlike '[\\x{061C}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]' group by file_id",
    "SourceInvisibleChar": r"select file_id, min(line_no) as line, '' as detail from lines where text rlike '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]' group by file_id",
}

FORM: dict[str, str] = {
    "DfmDefaultName": "select form_id as file_id, line, name as detail from comp where parent_id is not null and name rlike concat('(?i)^', regexp_replace(class, '^T', ''), '[0-9]+$')",
    "DfmHardcodedCaption": "select form_id as file_id, line, concat(path, ' = ', raw) as detail from prop where kind = 'String' and lower(path) in ('caption', 'hint', 'text') and raw rlike '[A-Za-z]{2}'",
    "DfmHardcodedDbCreds": r"""select c.form_id as file_id, p.line, concat(c.name, '.', p.path) as detail from comp c join prop p on p.form_id = c.form_id and p.comp_id = c.comp_id where c.class rlike '(?i)(Connection|Database|Session|Query|Login)'
        and (lower(p.path) = 'password' and p.kind = 'String' and p.raw <> '' or lower(p.path) in ('connectionstring', 'params.strings', 'params') and p.raw rlike '(?i)(password|pwd)=')""",
    "DfmDuplicateBinding": "select form_id as file_id, line, concat(datasource, '.', datafield) as detail from (select c.form_id, c.line, p.datasource, p.datafield, count(*) over (partition by c.form_id, lower(p.datasource), lower(p.datafield)) as n from comp c join pv p on p.form_id = c.form_id and p.comp_id = c.comp_id where p.datasource <> '' and p.datafield <> '') where n > 1",
    "DfmDeadEvent": "select e.form_id as file_id, e.line, concat(e.event, ' = ', e.handler) as detail from evt e join form f on f.form_id = e.form_id join klass k on k.file_id = f.unit_id and k.short = f.short where e.handler not like '%.%' and k.base in ('tform', 'tframe', 'tdatamodule') and not exists (select 1 from decl d where d.file_id = f.unit_id and d.owner = f.short and d.short = lower(e.handler))",
    "DfmOrphanHandler": "select d.file_id, d.line, d.name as detail from decl d join form f on f.unit_id = d.file_id and f.short = d.owner join ast p on p.file_id = d.file_id and p.parent_id = d.node_id and p.kind = 'Param' and lower(p.type_ref) = 'tobject' and lower(p.name) = 'sender' where d.mods like '%;published;%' and not exists (select 1 from evt e where e.form_id = f.form_id and lower(e.handler) = d.short)",
    "DfmEmptyBoundEvent": "select e.form_id as file_id, e.line, e.handler as detail from evt e join form f on f.form_id = e.form_id join meth m on m.file_id = f.unit_id and m.owner = f.short and m.short = lower(e.handler) join ast b on b.file_id = m.file_id and b.parent_id = m.node_id and b.kind = 'Block' and b.last_pre = b.node_id",
    "DfmSchemaMismatch": "select c.form_id as file_id, c.line, c.name as detail from comp c join form f on f.form_id = c.form_id join klass k on k.file_id = f.unit_id and k.short = f.short and k.base in ('tform', 'tframe', 'tdatamodule') where c.parent_id is not null and c.name <> '' and not c.is_inherited and not exists (select 1 from comp i where i.form_id = c.form_id and i.is_inline and c.line > i.line and c.line < i.end_line) and not exists (select 1 from ast x where x.file_id = f.unit_id and x.parent_id = k.node_id and x.kind = 'Field' and lower(x.name) = lower(c.name))",
    "DfmRequiredFieldUnbound": "select c.form_id as file_id, c.line, c.name as detail from comp c join pv p on p.form_id = c.form_id and p.comp_id = c.comp_id join comp ds on ds.form_id = c.form_id and ds.comp_id = c.parent_id where p.required = 'true' and p.fieldname is not null and not exists (select 1 from pv s join comp sc on sc.form_id = s.form_id and sc.comp_id = s.comp_id join pv b on b.form_id = s.form_id and lower(b.datasource) = lower(sc.name) where s.form_id = c.form_id and lower(s.dataset) = lower(ds.name) and lower(b.datafield) = lower(p.fieldname))",
    "DfmRequiredFieldNotVisible": "select c.form_id as file_id, c.line, c.name as detail from comp c join pv p on p.form_id = c.form_id and p.comp_id = c.comp_id and p.required = 'true' join comp ds on ds.form_id = c.form_id and ds.comp_id = c.parent_id join pv s on s.form_id = c.form_id and lower(s.dataset) = lower(ds.name) join comp sc on sc.form_id = s.form_id and sc.comp_id = s.comp_id join pv b on b.form_id = s.form_id and lower(b.datasource) = lower(sc.name) and lower(b.datafield) = lower(p.fieldname) group by c.form_id, c.comp_id, c.line, c.name having not bool_or(coalesce(b.visible, 'true') <> 'false')",
    "DfmFieldTypeMismatch": "select b.form_id as file_id, bc.line, concat(bc.class, ' for ', c.class) as detail from comp c join pv p on p.form_id = c.form_id and p.comp_id = c.comp_id and p.fieldname is not null join comp ds on ds.form_id = c.form_id and ds.comp_id = c.parent_id join pv s on s.form_id = c.form_id and lower(s.dataset) = lower(ds.name) join comp sc on sc.form_id = s.form_id and sc.comp_id = s.comp_id join pv b on b.form_id = s.form_id and lower(b.datasource) = lower(sc.name) and lower(b.datafield) = lower(p.fieldname) join comp bc on bc.form_id = b.form_id and bc.comp_id = b.comp_id where c.class = 'TBooleanField' and bc.class in ('TDBEdit', 'TDBMemo', 'TDBRichEdit', 'TDBImage') or c.class in ('TBlobField', 'TGraphicField') and bc.class in ('TDBEdit', 'TDBCheckBox') or c.class = 'TMemoField' and bc.class in ('TDBEdit', 'TDBCheckBox') or c.class rlike '^T(Integer|Float|Currency|BCD|FMTBCD|Smallint|Largeint|Date|DateTime|Time|SQLTimeStamp)Field$' and bc.class in ('TDBCheckBox', 'TDBMemo', 'TDBImage', 'TDBRichEdit')",
    "DfmTabOrderConflict": "select form_id as file_id, line, concat('TabOrder ', taborder) as detail from (select c.form_id, c.line, p.taborder, count(*) over (partition by c.form_id, c.parent_id, p.taborder) as n from comp c join pv p on p.form_id = c.form_id and p.comp_id = c.comp_id where p.taborder is not null) where n > 1",
    "DfmForbiddenClass": "select form_id as file_id, line, class as detail from comp where lower(class) in (select lower(class) from forbidden)",
    "DfmDbInUiForm": f"select c.form_id as file_id, c.line, concat(c.name, ': ', c.class) as detail from comp c join form f on f.form_id = c.form_id where c.class in ({DB}) and f.class not rlike '(?i)(DataModule|DM$|^TDM)'",
    "DfmCrossFormCoupling": "select distinct a.file_id, a.line, concat(g.name, '.', c.name) as detail from ast a join form f on f.unit_id = a.file_id join form g on g.form_id <> f.form_id join comp c on c.form_id = g.form_id and c.parent_id is not null and concat_ws(' ', a.name, a.type_ref) rlike concat('(?i)(?<![A-Za-z0-9_.])', g.name, '[.]', c.name, '(?![A-Za-z0-9_])') where a.kind in ('Assign', 'Call') and c.name <> '' and g.name <> ''",
    "DfmLayerViolation": f"select c.form_id as file_id, c.line, concat(c.name, ': ', c.class) as detail from comp c join comp r on r.form_id = c.form_id and r.comp_id = c.parent_id and r.parent_id is null where c.class in ({INPUTS})",
    "DfmGodHandler": "select form_id as file_id, min(line) as line, concat(min(handler), ' x ', count(*)) as detail from evt group by form_id, lower(handler) having count(*) >= :handlers and not (count(distinct comp_class) = 1 and count(distinct event) = 1)",
    "DfmActionMismatch": "select c.form_id as file_id, c.line, c.name as detail from comp c join pv p on p.form_id = c.form_id and p.comp_id = c.comp_id where p.action <> '' and p.onclick <> ''",
    "DfmMasterDetailUnlinked": "select c.form_id as file_id, c.line, c.name as detail from comp c join pv p on p.form_id = c.form_id and p.comp_id = c.comp_id where p.mastersource <> '' and p.masterfields is null",
    "DfmDataModuleSplitHint": f"select c.form_id as file_id, 1 as line, array_join(slice(array_sort(collect_set(c.name)), 1, 5), ', ') as detail from comp c join form f on f.form_id = c.form_id where c.class in ({DB}) and f.class not rlike '(?i)(DataModule|DM$|^TDM)' group by c.form_id having count(*) >= 3",
    "DfmComponentUnused": "select c.form_id as file_id, c.line, c.name as detail from comp c join form f on f.form_id = c.form_id where c.parent_id is not null and c.name <> '' and not c.is_inherited and not exists (select 1 from tok t where t.file_id = f.unit_id and t.kind = 'ident' and lower(t.value) = lower(c.name) and not exists (select 1 from ast x where x.file_id = t.file_id and x.kind = 'Field' and x.line = t.line and x.col = t.col)) and not exists (select 1 from prop p where p.form_id = c.form_id and lower(p.raw) = lower(c.name)) and not exists (select 1 from evt e where e.form_id = c.form_id and e.comp_id = c.comp_id)",
}
