"""Comparing two profiles: diffs, presence, type changes, evolution and migration impact.

A profile has the columns path, kind (scalar, object or array), atoms (joined
by |, sorted) and required. All texts below are joins on path; both sides have
one row per path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.functions import lexicon as w
from schemaloom.plans.dialect import has, run, values
from schemaloom.sources.fields import Field

PROFILE = ["path", "kind", "atoms", "required"]

LEAF = "replace_all(path, '^.*[.]', '')"
_SHOWN = "case when regexp_like(atoms, '[|]') then concat('union(', atoms, ')') else atoms end"


#: Atoms in order, and those that stand for the same one.
ATOMS = ["any", "array", "bool", "bytes", "date", "datetime", "float", "geography", "int", "interval", "json", "missing", "number", "object", "str", "time", "timestamp"]
_SAME = {"array": "array|empty_array", "object": "object|empty_object", "str": "str|empty_string"}


def _has(atoms: str, names: str) -> str:
    return f"regexp_like({atoms}, '(^|[|])({names})($|[|])')"


def normal(atoms: str, missing: str = "false") -> str:
    """Atoms sorted, each once, empty kinds as their base, `any` only where it is all that is known; `missing` where the condition holds."""
    known = "|".join(_SAME.get(a, a) for a in ATOMS if a not in ("any", "missing"))
    tests = {"any": f"{_has(atoms, 'any')} and not {_has(atoms, known)}", "missing": f"{_has(atoms, 'missing')} or {missing}"}
    parts = ", ".join(f"case when {tests.get(a) or _has(atoms, _SAME.get(a, a))} then '{a}' end" for a in ATOMS)
    return f"coalesce(nullif(concat_ws('|', {parts}), ''), {atoms})"


def _kids(side: str, path: str) -> str:
    """An array's members stand in the profile."""
    return f"exists (select 1 from {{{side}}} as k where starts_with(k.path, concat({path}, '[0].')))"


def _leaves(side: str) -> str:
    """Paths that hold no members; arrays of objects are entered."""
    return f"(select path, kind, atoms, required from {{{side}}} as q where kind <> 'object' and not (kind = 'array' and {_kids(side, 'q.path')}))"


def _flat(side: str) -> str:
    """Paths that hold no members; arrays are not entered."""
    return f"(select path, kind, {normal('atoms')} as atoms, required from {{{side}}} as q where kind <> 'object' and path = replace(path, '[0]', ''))"


def _present(side: str) -> str:
    """Normal atoms, with `missing` where a path that holds no members is optional."""
    optional = f"(not required and kind <> 'object' and not (kind = 'array' and {_kids(side, 'q.path')}))"
    return f"(select path, kind, required, {normal('atoms', optional)} as atoms, kind = 'array' and {_kids(side, 'q.path')} as has_kids from {{{side}}} as q)"


_BASE = "replace_all(replace_all(replace_all({a}, '(^|[|])missing', ''), '^[|]', ''), '[|]$', '')"


def base_of(a: str) -> str:
    """Atoms without `missing`."""
    return _BASE.replace("{a}", a)


def shown(a: str) -> str:
    """Atoms as a type: several as a union."""
    return f"case when regexp_like({a}, '[|]') then concat('union(', {a}, ')') else {a} end"


def base_shown(a: str) -> str:
    """The type without `missing`; of what is only missing, that."""
    return f"case when {base_of(a)} = '' then 'missing' when regexp_like({base_of(a)}, '[|]') then concat('union(', {base_of(a)}, ')') else {base_of(a)} end"


def nullable(a: str) -> str:
    return f"regexp_like({a}, '(^|[|])missing($|[|])')"


_BOTH = f"select coalesce(l.path, r.path) as path, l.atoms as left_atoms, r.atoms as right_atoms, coalesce(l.kind, r.kind) as kind, coalesce(l.has_kids, false) or coalesce(r.has_kids, false) as has_kids from {_present('left')} as l full outer join {_present('right')} as r on l.path = r.path"
_KNOWN = f"left_atoms <> right_atoms and not {_has('left_atoms', 'any')} and not {_has('right_atoms', 'any')}"
_GONE = f"({base_of('left_atoms')} = '' or {base_of('right_atoms')} = '')"
_TYPES = f"{_KNOWN} and not {_GONE} and {base_of('left_atoms')} <> {base_of('right_atoms')}"
_NULLS = f"{_KNOWN} and ({_GONE} or {nullable('left_atoms')} <> {nullable('right_atoms')})"
_PRESENCE = f"{_NULLS} and ({_GONE} or {base_of('left_atoms')} = {base_of('right_atoms')})"
_REQUIRED = "case when {n} then 'nullable' else 'required' end"


def _only(side: str, other: str) -> str:
    """Paths of one side alone, the topmost of each branch."""
    above = f"exists (select 1 from b as o where o.{other}_atoms is null and (starts_with(b.path, concat(o.path, '.')) or starts_with(b.path, concat(o.path, '[0].'))))"
    shown_ = {"left": ("left_atoms", "null"), "right": ("null", "right_atoms")}[side]
    return f"select path, 'only_{side}' as section, {shown_[0]} as left_atoms, {shown_[1]} as right_atoms from b where {other}_atoms is null and not {above}"


_REPORT = f"""with b as ({_BOTH}), report as ({_only('left', 'right')}
   union all {_only('right', 'left')}
   union all select path, 'type_mismatch' as section, {base_shown('left_atoms')} as left_atoms, {base_shown('right_atoms')} as right_atoms from b where {_TYPES}
   union all select path, 'presence' as section, {_REQUIRED.replace('{n}', nullable('left_atoms'))} as left_atoms, {_REQUIRED.replace('{n}', nullable('right_atoms'))} as right_atoms from b where {_NULLS}
   union all select path, 'common' as section, left_atoms, right_atoms from b where left_atoms = right_atoms and kind <> 'object' and not has_kids)"""
_WIDER = values(["from_atom", "to_atom"], w.WIDENING)
#: Changes of types and of constraints are told apart; a path may have both.
_EVO = f"""with f as (select coalesce(l.path, r.path) as path, l.atoms as old_type, r.atoms as new_type, l.required as was, r.required as now from {_flat('left')} as l full outer join {_flat('right')} as r on l.path = r.path),
 judged as (select path, 'removed' as change, {shown('old_type')} as old_type, {shown('new_type')} as new_type, true as breaking from f where new_type is null
   union all select path, 'added', {shown('old_type')}, {shown('new_type')}, now from f where old_type is null
   union all select f.path, 'type_changed', {shown('f.old_type')}, {shown('f.new_type')}, x.from_atom is null from f left join {_WIDER} as x on f.old_type = x.from_atom and f.new_type = x.to_atom where f.old_type <> f.new_type
   union all select path, case when now then 'now_required' else 'now_optional' end, {shown('old_type')}, {shown('new_type')}, now from f where was <> now)"""
_MOVES = f"""(select leaf, listagg(case when l and r then path end) as shared, count(case when l and not r then 1 end) as left_only, count(case when r and not l then 1 end) as right_only,
  listagg(case when l and not r then path end) as left_paths, listagg(case when r and not l then path end) as right_paths from (
  select coalesce(a.path, b.path) as path, {LEAF.replace('path', 'coalesce(a.path, b.path)')} as leaf, a.path is not null as l, b.path is not null as r from {_leaves('left')} as a full outer join {_leaves('right')} as b on a.path = b.path) as m group by leaf)"""

TEXTS: dict[str, str] = {
    "flatten_paths": f"select path from {_leaves('left')} as p",
    "paths_by_name": f"select {LEAF} as leaf, listagg(path) as paths, count(*) as n from {_leaves('left')} as p group by {LEAF}",
    "path_changes": f"select leaf, shared, left_paths, right_paths from {_MOVES} as m where left_only > 0 and right_only > 0",
    "filter_fields": "select p.path, p.kind, p.atoms from {left} as p where exists (select 1 from {wanted} as q where replace(p.path, '[0]', '') = q.path or starts_with(replace(p.path, '[0]', ''), concat(q.path, '.')))",
    "presence_wrap": f"select path, case when required then {shown('atoms')} when {_has('atoms', 'missing')} or kind = 'array' then case when kind = 'array' then 'union(array|missing)' else {shown('atoms')} end when regexp_like(atoms, '[|]') then concat('union(', {normal('atoms', 'true')}, ')') else concat('union(', atoms, '|missing)') end as wrapped from {_leaves('left')} as p",
    "presence_inject": f"select path, atoms from {_present('left')} as p where kind <> 'object'",
    "fmt_path": "select path, replace_all(replace(path, '[0]', '[]'), '^[.]+', '') as shown from {left} as p",
    "union_str": f"select path, {_SHOWN} as type_repr from {{left}} as p",
    "norm_empty": "select path, replace_all(replace_all(replace_all(atoms, 'empty_string', 'str'), 'empty_object', 'object'), 'empty_array', 'array') as atoms from {left} as p",
    "norm_union": f"select path, {normal('atoms')} as atoms from {{left}} as p",
    "norm_walk": f"select path, {shown(normal('atoms'))} as type_repr, kind from {{left}} as p",
    "norm_has_any": "select path, regexp_like(atoms, '(^|[|])any($|[|])') as has_any from {left} as p",
    "diff_trees": f"{_REPORT} select path, section, left_atoms, right_atoms from report",
    "diff_report": f"{_REPORT} select section, count(*) as n, listagg(path) as paths from report where section in ('only_left', 'only_right', 'type_mismatch', 'presence') group by section",
    "diff_onlyleft": f"{_REPORT} select path from report where section = 'only_left'",
    "diff_onlyright": f"{_REPORT} select path from report where section = 'only_right'",
    "diff_common": f"select l.path from {_leaves('left')} as l join {_leaves('right')} as r on l.path = r.path",
    "diff_structuring": f"select l.path, case when {_kids('right', 'l.path')} then 'structured' else 'unstructured' end as change from {{left}} as l join {{right}} as r on l.path = r.path where l.kind = 'array' and r.kind = 'array' and ({_kids('left', 'l.path')}) <> ({_kids('right', 'l.path')})",
    "type_split": f"select path, {base_shown('atoms')} as base, {nullable('atoms')} as nullable from {_present('left')} as p",
    "type_change": f"with b as ({_BOTH}) select path, {base_of('left_atoms')} <> {base_of('right_atoms')} and not {_GONE} as type_changed, {_GONE} or {nullable('left_atoms')} <> {nullable('right_atoms')} as nullability_changed from b where left_atoms is not null and right_atoms is not null and left_atoms <> right_atoms",
    "type_presence": f"with b as ({_BOTH}) select path, {_PRESENCE} as presence_only from b where left_atoms is not null and right_atoms is not null",
    "presence_fmt": f"select path, case when atoms = 'missing' then 'nullable' when {nullable('atoms')} and not regexp_like({base_of('atoms')}, '[|]') then concat('nullable ', {base_of('atoms')}) else {shown('atoms')} end as for_schema, case when atoms = 'missing' then 'missing data' when {nullable('atoms')} and not regexp_like({base_of('atoms')}, '[|]') then {base_of('atoms')} else {shown('atoms')} end as for_data from {_present('left')} as p",
    "evo_basic": f"{_EVO} select path, change, old_type, new_type, breaking from judged",
    "evo_breaking": f"{_EVO} select path, old_type, new_type, breaking from judged where change = 'type_changed'",
    "evo_advanced": f"""{_EVO}, s as (select cast(sum(case when breaking then 1 else 0 end) as bigint) as breaking, cast(sum(case when change = 'type_changed' then 1 else 0 end) as bigint) as types, cast(sum(case when change = 'removed' then 1 else 0 end) as bigint) as removed, cast(sum(case when change = 'added' then 1 else 0 end) as bigint) as added from judged),
      d as (select cast(abs((select max(length(replace_all(path, '[^.]', ''))) from {{right}} as q) - (select max(length(replace_all(path, '[^.]', ''))) from {{left}} as p)) as bigint) as depth_change)
      select breaking, types, removed, added, depth_change, 3 * breaking + 2 * types + 2 * depth_change + removed as score, case when 3 * breaking + 2 * types + 2 * depth_change + removed = 0 then 'trivial' when 3 * breaking + 2 * types + 2 * depth_change + removed <= 3 then 'low' when 3 * breaking + 2 * types + 2 * depth_change + removed <= 8 then 'medium' when 3 * breaking + 2 * types + 2 * depth_change + removed <= 15 then 'high' else 'very_high' end as effort from s cross join d""",
    "model_lookup": f"select path, kind, atoms from {_flat('left')} as p where required",
    "mig_removals": f"{_REPORT} select path, {has('lower(' + LEAF + ')', w.CRITICAL)} as critical from report where section = 'only_left'",
    "mig_types": f"{_REPORT} select count(*) as mismatches, case when count(*) > 5 then 'extensive' when count(*) > 0 then 'some' else 'none' end as extent from report where section = 'type_mismatch'",
    "mig_additions": f"{_REPORT} select case when {has('lower(' + LEAF + ')', w.METADATA)} then 'metadata' else 'business' end as purpose, count(*) as n from report where section = 'only_right' group by case when {has('lower(' + LEAF + ')', w.METADATA)} then 'metadata' else 'business' end",
    "mig_presence": f"{_REPORT} select count(*) as n from report where section = 'presence'",
    "mig_paths": f"select count(*) as moved, case when count(*) > 5 then 'extensive' when count(*) > 0 then 'some' else 'none' end as extent from {_MOVES} as m where left_only > 0 and right_only > 0",
    "mig_analyze": f"""{_REPORT}, t as (select cast(sum(case when section = 'only_left' and {has('lower(' + LEAF + ')', w.CRITICAL)} then 1 else 0 end) as bigint) as critical_removed, cast(sum(case when section = 'only_left' then 1 else 0 end) as bigint) as removed, cast(sum(case when section = 'only_right' then 1 else 0 end) as bigint) as added,
      cast(sum(case when section = 'type_mismatch' then 1 else 0 end) as bigint) as mismatches, cast(sum(case when section = 'presence' then 1 else 0 end) as bigint) as presence, cast(sum(case when section = 'common' then 1 else 0 end) as bigint) as common from report)
      select critical_removed, removed, added, mismatches, presence, common, case when critical_removed > 0 or mismatches > 0 then 'breaking' when removed > 0 or added > 0 or presence > 0 then 'review' else 'compatible' end as verdict from t""",
}


def compare(spark: SparkSession, name: str, **sides: DataFrame) -> DataFrame:
    """Run one text over left, right and wanted (path)."""
    return run(spark, TEXTS[name], **sides)


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, section (only_left, only_right, type_mismatch, presence, common), left_atoms, right_atoms."""
    return compare(left.sparkSession, "diff_trees", left=left, right=right)


def evolution(old: DataFrame, new: DataFrame) -> DataFrame:
    return compare(old.sparkSession, "evo_basic", left=old, right=new)


_ATOMS = {"INT64": "int", "FLOAT64": "float", "NUMERIC": "float", "BOOLEAN": "bool", "STRING": "str", "BYTES": "str", "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp", "DATETIME": "timestamp", "RECORD": "object", "JSON": "object"}


def profile(spark: SparkSession, fields: list[Field]) -> DataFrame:
    """path, kind, atoms, required."""
    rows = []

    def walk(fields: list[Field], prefix: str) -> None:
        for f in fields:
            path = prefix + f.name
            many = f.mode == "REPEATED"
            rows.append((path, "array" if many else "object" if f.type == "RECORD" else "scalar", "array" if many else _ATOMS.get(f.type, "any"), f.mode == "REQUIRED" or f.required or not many and f.type == "RECORD"))
            walk(f.fields, path + ("[0]." if many else "."))

    walk(fields, "")
    return spark.createDataFrame(rows, "path string, kind string, atoms string, required boolean")


def plain_path(path: str) -> str:
    """root['a']['b'] as a.b."""
    return path.removeprefix("root").replace("']['", ".").replace("['", ".").replace("']", "").lstrip(".")
