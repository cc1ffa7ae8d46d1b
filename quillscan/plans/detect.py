"""The detection plan: gates, match generation, secrets, filters, locations, relations and suppression.

Rules are literals of the plan: one pass over a fragment finds the keywords of all rules; it passes a rule's cheap gates
before its regular expression (compiled once a task) is tried, and is exploded only into the rules that match it. The
places of a text's matches come from sums over its parts and lines, in time linear in the text and its matches. Up to the findings nothing is shuffled, and the text
goes no further than that; relations and suppression are equi-joins by fragment of the stored findings, so that the text is
scanned once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions import text as T
from quillscan.functions.dialect import to_java
from quillscan.rules import Allowlist, Rule, RuleSet, allowed_by, joined
from quillscan.session import stored

FRAGMENT = {"fragment_id": "long", "file_path": "string", "commit": "string", "start_line": "int", "content": "string", "author": "string", "email": "string", "date": "string", "message": "string"}


@dataclass(frozen=True)
class Options:
    max_target_bytes: int | None = None
    redaction_percent: int = 0
    honor_allow_markers: bool = True


def fragments(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a fragment: what it lacks is empty (start_line: 0), other columns are dropped."""
    return df.select(*completed(df.columns), F.col("fragment_id").cast("long"))


def completed(have: list[str]) -> list[Column]:
    """All columns of a fragment but its id: those that a table has of them, without nulls, and defaults."""
    default = lambda c, t: F.lit(0) if t == "int" else F.lit("")
    return [(F.coalesce(F.col(c).cast(t), default(c, t)) if c in have else default(c, t).cast(t)).alias(c) for c, t in FRAGMENT.items() if c != "fragment_id"]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def settled(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` with more columns, computed once for a row: no filter or projection on them repeats what they are made of."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in values.items())))).alias("_settled")
    return rows.select("*", made).select(*rows.columns, *(F.col("_settled")[name].alias(name) for name in values))


def _gate_allows(a: Allowlist) -> Column:
    """Whether an allowlist's commits or paths pass over a whole fragment."""
    commit = F.lower(F.trim("commit")).isin(list(a.commits)) if a.commits else None
    path = F.col("file_path").rlike(to_java(joined(a.paths))) if a.paths else None
    parts = [x for x in (commit, path) if x is not None]
    if not parts or a.condition == "AND" and (a.regexes or a.stopwords):
        return F.lit(False)
    return _all(parts) if a.condition == "AND" else _any(parts)


def _finding_allows(a: Allowlist) -> Column:
    """Whether an allowlist passes over a finding: by its regexes and stopwords, or (AND) by all parts that are set."""
    target = F.col({"secret": "secret", "match": "match", "line": "line"}[a.regex_target])
    parts = {}
    if a.regexes:
        parts["regexes"] = target.rlike(to_java(joined(a.regexes)))
    if a.stopwords:
        parts["stopwords"] = _any([F.contains(F.lower("secret"), F.lit(w)) for w in a.stopwords])
    if a.condition == "OR":
        return _any(list(parts.values()))
    if a.commits:
        parts["commits"] = F.lower(F.trim("commit")).isin(list(a.commits))
    if a.paths:
        parts["paths"] = F.col("file_path").rlike(to_java(joined(a.paths)))
    return _all([parts[k] for k in allowed_by(a)])


def _named(allows: list[Column]) -> Column:
    """The gate holds only for fragments with a path or a commit."""
    return ((F.length("file_path") > 0) | (F.length("commit") > 0)) & _any(allows)


#: Up to so many keywords each is looked for by itself, which is faster than a pattern of all.
_FEW = 8


def _searched(frags: DataFrame, content: list[Rule]) -> tuple[DataFrame, list[str]]:
    """``frags`` with the lower-cased text, or with the keywords in it (the longest at each place) if the rules have many."""
    keywords = sorted({k for r in content for k in r.keywords if k})
    if len(keywords) <= _FEW:
        return frags.withColumn("low", F.lower("content")), []
    return frags.withColumn("seen", F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(T.keyword_pattern(keywords)), F.lit(1)))), keywords


def _gate(rule: Rule, options: Options, keywords: list[str]) -> Column:
    """Cheap gates of a rule: keywords, path, size, allowlists of commits and paths."""
    parts = []
    if rule.keywords and rule.regex:
        words = [k for k in rule.keywords if k]
        parts.append(F.arrays_overlap("seen", F.array(*(F.lit(k) for k in keywords if any(k.startswith(w) for w in words)))) if keywords else _any([F.contains(F.col("low"), F.lit(w)) for w in words]))
    if rule.path:
        parts.append(F.col("file_path").rlike(to_java(rule.path)))
    if options.max_target_bytes is not None:
        parts.append(F.octet_length("content") <= options.max_target_bytes)
    if gates := [_gate_allows(a) for a in rule.allowlists if a.commits or a.paths]:
        parts.append(~_named(gates))
    return _all(parts) if parts else F.lit(True)


#: Stands for a match where a text is cut at its matches; a text that has it itself is cut by the pattern, which is compiled anew.
_CUT = "\ue000"


def _secret(rule: Rule, match: Column) -> Column:
    """The secret of a match of ``rule``: the chosen group, else the first group that isn't empty, else the match."""
    group = lambda g: F.regexp_extract(match, rule.java, g)
    if rule.secret_group > 0:
        return F.when(F.regexp_like(match, F.lit(rule.java)), group(rule.secret_group)).otherwise(match)
    if not rule.groups:
        return match
    return F.coalesce(F.get(F.filter(F.array(*(group(g) for g in range(1, rule.groups + 1))), lambda x: x != ""), F.lit(0)), match)


def _parts(rule: Rule) -> Column:
    """The content cut into gaps and the matches after them (null after the last): gap, m, match (m without line feeds at its
    edges), secret."""
    content, pattern = F.col("content"), F.lit(rule.java)
    gaps = F.when(F.contains("content", F.lit(_CUT)), F.split(content, pattern, -1)).otherwise(F.split(F.regexp_replace(content, pattern, F.lit(_CUT)), _CUT, -1))
    one = lambda m: T.let(F.trim(m, F.lit("\n")), lambda match: F.struct(m.alias("m"), match.alias("match"), _secret(rule, match).alias("secret")))
    found = F.transform(F.regexp_extract_all(content, pattern, F.lit(0)), one)
    return F.zip_with(gaps, found, lambda gap, x: F.struct(gap.alias("gap"), x["m"].alias("m"), x["match"].alias("match"), x["secret"].alias("secret")))


def path_findings(frags: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings of rules with a path but no regex: the path itself, without a location."""
    only = [r for r in rules.rules if r.path and not r.regex and not r.skip_report]
    named = F.array(*(F.when(F.col("file_path").rlike(to_java(r.path)) & ~_named([_gate_allows(a) for a in r.allowlists]), F.struct(F.lit(r.id).alias("id"), F.lit(r.description).alias("description"))) for r in only))
    rows = frags.select("*", F.explode(F.filter(named, lambda x: x.isNotNull()) if only else F.array().cast("array<struct<id:string,description:string>>")).alias("r"))
    return rows.select(*frags.columns, F.col("r.id").alias("rule_id"), F.col("r.description").alias("description"), F.concat(F.lit("file detected: "), "file_path").alias("match"))


def content_rules(rules: RuleSet) -> list[Rule]:
    """The rules with a regex; if there are none, one that matches nothing."""
    return [r for r in rules.rules if r.regex] or [Rule("none", regex=r"\z\A.")]


def opened(frags: DataFrame, content: list[Rule], options: Options) -> DataFrame:
    """(fragment_id, rule_no) of the rules whose cheap gates open."""
    searched, keywords = _searched(frags, content)
    gates = F.array(*(F.when(_gate(r, options, keywords), F.lit(k)) for k, r in enumerate(content)))
    return searched.select("fragment_id", F.explode(F.filter(gates, lambda x: x.isNotNull())).alias("rule_no"))


def matches(frags: DataFrame, rules: RuleSet, options: Options = Options(), located: Callable[[Column, Column], Column] = T.match_places) -> DataFrame:
    """Whole matches of every content rule whose gates open: fragment columns but for the content, rule_no, start (untrimmed), match (trimmed
    of line feeds), secret, match_start, match_end, secret_start, secret_end."""
    content = content_rules(rules)
    if allow := [_gate_allows(a) for a in rules.allowlists if a.commits or a.paths]:
        frags = frags.where(~_named(allow))
    searched, keywords = _searched(frags, content)
    # each rule's expressions have its pattern as a literal, which is compiled once a task
    hits = F.array(*(F.when(_gate(r, options, keywords) & F.col("content").rlike(r.java), F.struct(F.lit(k).alias("rule_no"), _parts(r).alias("parts"))) for k, r in enumerate(content)))
    rows = searched.select(*frags.columns, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("hit"))
    rows = rows.select(*(c for c in frags.columns if c != "content"), F.col("hit.rule_no").alias("rule_no"), F.explode(T.let(F.col("hit.parts"), lambda p: located(F.col("content"), p))).alias("place"))
    rows = rows.withColumn("whole", F.col("place.m")).withColumn("start", F.col("place.start")).withColumn("match", F.col("place.match")).withColumn("secret", F.col("place.secret"))
    lead = F.octet_length("whole") - F.octet_length(F.ltrim("whole", F.lit("\n")))
    rows = rows.withColumn("match_start", F.col("start") + lead).withColumn("match_end", F.col("start") + lead + F.octet_length("match"))
    # where the secret stands first in its match
    offset = F.octet_length(F.call_function("substring_index", F.col("match"), F.col("secret"), F.lit(1)))
    return rows.withColumn("secret_start", F.when(F.length("secret") > 0, F.col("match_start") + offset)).withColumn("secret_end", F.col("secret_start") + F.octet_length("secret"))


def in_place(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Matches, and their locations."""
    return rows, T.match_location(F.col("place"), F.col("start_line"))


def candidates(frags: DataFrame, rules: RuleSet, options: Options = Options(), places: Callable[[DataFrame], tuple[DataFrame, dict[str, Column]]] = in_place) -> DataFrame:
    """Matches that pass entropy, allow markers and allowlists, with locations; helpers (skip_report) among them."""
    content = content_rules(rules)
    pick = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("rule_no"))
    rows = matches(frags, rules, options, T.match_places if places is in_place else T.match_starts)
    entropy = {"entropy": T.shannon_entropy(F.col("secret"))}
    if any(r.entropy for r in content):
        rows = settled(rows, entropy).where((pick([r.entropy for r in content]) == 0) | (F.col("entropy") > pick([r.entropy for r in content])))
    else:  # a query that doesn't return it needn't compute it
        rows = rows.withColumns(entropy)
    if any(r.byte_entropy for r in content):
        rows = rows.withColumn("bytes_h", T.byte_entropy(F.col("secret")))
        for k, r in enumerate(content):
            if r.byte_entropy:
                kind, least = r.byte_entropy
                rows = rows.where((F.col("rule_no") != k) | (F.col("bytes_h") >= least if kind == "lt" else F.col("bytes_h") > least))
        rows = rows.drop("bytes_h")
    rows, located = places(rows)
    rows = settled(rows, {{"start_line": "first_line"}.get(name, name): column for name, column in located.items()})
    rows = rows.drop("start_line", "original", "whole", "place", "at").withColumnRenamed("first_line", "start_line")
    if options.honor_allow_markers:
        rows = rows.where(~T.has_allow_marker(F.col("line")))
    for a in rules.allowlists:
        rows = rows.where(~_finding_allows(a))
    for k, r in enumerate(content):
        for a in r.allowlists:
            rows = rows.where((F.col("rule_no") != k) | ~_finding_allows(a))
    rows = rows.withColumn("rule_id", pick([r.id for r in content])).withColumn("description", pick([r.description for r in content]))
    tags = F.get(F.array(*(F.array(*(F.lit(t) for t in r.tags)).cast("array<string>") for r in content)), F.col("rule_no"))
    return rows.withColumn("tags", tags).withColumn("skip_report", pick([r.skip_report for r in content]))


def with_required(found: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings of rules that require others only where each has a helper near enough, in the same fragment and decode pass
    (if there are any); plus required_findings: the helpers. Findings that require nothing have an empty list."""
    passes = [F.col("depth").alias("hd")] if "depth" in found.columns else []
    rows = found.withColumn("row", F.struct("rule_id", "match_start", "match_end", *(["depth"] if passes else [])))
    needs = [(r, q) for r in rules.rules for q in r.required]
    plain = rows.where(~F.col("rule_id").isin([r.id for r, _ in needs])) if needs else rows
    helper = F.struct("rule_id", "start_line", "start_column", "line", "match", "secret")
    out = plain.withColumn("required_findings", F.array().cast(f"array<{rows.select(helper.alias('x')).schema['x'].dataType.simpleString()}>"))
    for rule in {r.id: r for r, _ in needs}.values():
        mine = rows.where(F.col("rule_id") == rule.id)
        for k, q in enumerate(rule.required):
            h = rows.where(F.col("rule_id") == q.id).select(F.col("fragment_id").alias("hf"), *passes, F.col("start_line").alias("hl"), F.col("start_column").alias("hc"), F.col("match_start").alias("hs"), F.col("match_end").alias("he"), helper.alias("helper"))
            near = [F.col("fragment_id") == F.col("hf")] + ([F.col("depth") == F.col("hd")] if passes else [])
            if q.relation == "same-candidate":
                near += [F.col("match_start") == F.col("hs"), F.col("match_end") == F.col("he")]
            elif q.relation == "window":
                if q.lines:
                    near.append(F.col("hl").between(F.col("start_line") - (q.lines - 1), F.col("end_line") + (q.lines - 1)))
            else:
                near += [F.abs(F.col("start_line") - F.col("hl")) <= q.lines] if q.lines is not None else []
                near += [F.abs(F.col("start_column") - F.col("hc")) <= q.columns] if q.columns is not None else []
            helpers = mine.select("fragment_id", *(["depth"] if passes else []), "row", "start_line", "end_line", "start_column", "match_start", "match_end").join(h, _all(near)).groupBy(F.col("fragment_id").alias("of"), F.col("row").alias("of_row")).agg(F.array_sort(F.collect_list("helper")).alias(f"helpers_{k}"))
            mine = mine.join(helpers, (F.col("fragment_id") == F.col("of")) & (F.col("row") == F.col("of_row"))).drop("of", "of_row")
        joined_helpers = F.concat(*(F.col(f"helpers_{k}") for k in range(len(rule.required))))
        out = out.unionByName(mine.withColumn("required_findings", joined_helpers).select(*out.columns))
    return out.drop("row")


def without_generic(found: DataFrame) -> DataFrame:
    """Drops a generic rule's finding where another rule's, on the same line and commit, has its secret within its own."""
    key = ["fragment_id", "start_line", "commit"]
    others = found.where(~F.contains(F.lower("rule_id"), F.lit("generic"))).select(*(F.col(c).alias(f"o_{c}") for c in key), F.col("secret").alias("o_secret"))
    hidden = _all([F.col(c) == F.col(f"o_{c}") for c in key]) & F.contains("o_secret", F.col("secret"))
    generic = F.contains(F.lower("rule_id"), F.lit("generic"))
    return found.where(~generic).unionByName(found.where(generic).join(others, hidden, "left_anti"))


REPORT = ["fragment_id", "rule_id", "description", "start_line", "end_line", "start_column", "end_column", "match_start", "match_end", "secret_start", "secret_end", "line", "match", "secret", "file", "commit", "entropy", "author", "email", "date", "message", "tags", "fingerprint", "required_findings"]


def detect(df: DataFrame, rules: RuleSet, options: Options = Options()) -> DataFrame:
    """All findings of ``rules`` in ``df`` (see FRAGMENT; fragment_id is unique), one row each."""
    frags = fragments(df)
    found = finished(candidates(frags, rules, options), rules, options)
    out = found.select(*REPORT)
    if any(r.path and not r.regex for r in rules.rules):
        by_path = path_findings(frags, rules).withColumnRenamed("file_path", "file")
        zero = {c: F.lit(0) for c in ("start_line", "end_line", "start_column", "end_column")}
        shaped = {"fingerprint": T.fingerprint(F.col("file"), F.col("rule_id"), F.lit(0), F.col("commit")), "line": F.lit(""), "secret": F.lit(""), "entropy": F.lit(0.0)} | zero
        empty = {f.name: F.lit(None) for f in out.schema}
        have = {c: F.col(c) for c in ("fragment_id", "rule_id", "description", "match", "file", "commit", "author", "email", "date", "message")}
        out = out.unionByName(by_path.select(*((empty | have | shaped)[f.name].cast(f.dataType).alias(f.name) for f in out.schema)))
    return out


def finished(found: DataFrame, rules: RuleSet, options: Options) -> DataFrame:
    """Candidates after relations, suppression, fingerprints and redaction."""
    related = any(r.required for r in rules.rules)
    generic = any("generic" in r.id.lower() for r in rules.rules) and len(rules.rules) > 1
    if related or generic:  # joins of the findings with each other: of a table
        found = stored(found)
    found = with_required(found, rules).where(~F.col("skip_report"))
    found = (without_generic(found) if generic else found).withColumnRenamed("file_path", "file").withColumn("entropy", F.col("entropy").cast("float"))
    found = found.withColumn("fingerprint", T.fingerprint(F.col("file"), F.col("rule_id"), F.col("start_line"), F.col("commit")))
    if options.redaction_percent:
        for c in ("line", "match"):
            found = found.withColumn(c, T.redacted(F.col(c), F.col("secret"), options.redaction_percent))
        found = found.withColumn("secret", T.masked_secret(F.col("secret"), options.redaction_percent))
    return found
