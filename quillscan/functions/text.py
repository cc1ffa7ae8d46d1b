"""Column functions of secret detection. Offsets and lengths are UTF-8 bytes unless said otherwise."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ALLOW_MARKERS = ("quillscan:allow", "gitleaks:allow")


#: Elements that a running sum adds up at once; the sums of so many are added up in turn.
_STEP = 128
#: An array of up to so many is summed in one level.
_FEW = 8


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` where the value is computed once for a row, however often (and in whatever lambda) ``f`` uses it.

    It is computed within a struct, whose type Spark keeps: that of a bare one is derived anew wherever it is asked for, for
    each row too, in steps that double with each level of nesting.
    """
    return F.get(F.transform(F.array(value), lambda x: F.struct(f(x).alias("v"))), F.lit(0))["v"]


def running_sum(values: Column) -> Column:
    """The sums of an array of ints up to each place, in two levels: a fold that appends to an array would copy it each time."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)

    def summed(v: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _STEP).cast("int"))
        sums = F.transform(parts, lambda j: total(F.slice(v, j * _STEP + 1, F.lit(_STEP))))
        heads = let(sums, lambda s: F.transform(s, lambda _, j: total(F.slice(s, F.lit(1), j))))
        long = let(heads, lambda h: F.transform(v, lambda _, i: F.get(h, F.floor(i / _STEP).cast("int")) + total(F.slice(v, i - i % _STEP + 1, i % _STEP + 1))))
        return F.when(F.size(v) <= _FEW, F.transform(v, lambda _, i: total(F.slice(v, F.lit(1), i + 1)))).otherwise(long)

    return let(values, summed)


def keyword_pattern(words: Sequence[str]) -> str:
    """A pattern that at each place of a text captures the longest of ``words`` that stands there, by their common prefixes.

    Words that begin with others imply them.
    """
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    plain = lambda c: c if c.isalnum() else f"\\x{{{ord(c):x}}}"

    def pattern(node: dict) -> str:
        nexts = sorted(c for c in node if c)
        parts = [plain(c) + pattern(node[c]) for c in nexts]
        if len(parts) > 8:  # a choice is tried branch by branch: first of some classes, then within one
            step = math.isqrt(len(parts))
            parts = [f"(?=[{''.join(map(plain, nexts[k : k + step]))}])(?:{'|'.join(parts[k : k + step])})" for k in range(0, len(parts), step)]
        return (f"(?:{'|'.join(parts)}){'?' if '' in node else ''}" if len(parts) > 1 or "" in node else parts[0]) if parts else ""

    return f"(?=({pattern(tree)}))"


def _entropy(text: Column, size: Callable[[Column], Column]) -> Column:
    """The counts of characters over ``size``, summed in order of the characters; a character is counted by removing it."""

    def bits(t: Column) -> Column:
        chars = F.array_sort(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")))
        shares = let(size(t).cast("double"), lambda n: F.transform(chars, lambda c: (F.octet_length(t) - F.octet_length(F.replace(t, c, F.lit("")))) / F.octet_length(c) / n))
        return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))

    return let(text, bits)


def shannon_entropy(secret: Column) -> Column:
    """Bits per symbol: the counts of characters over the length in bytes."""
    return _entropy(secret, F.octet_length)


def byte_entropy(secret: Column) -> Column:
    """Bits per byte over a histogram of bytes."""
    return _entropy(F.decode(F.encode(secret, "UTF-8"), "ISO-8859-1"), F.length)  # a character a byte


def fingerprint(file: Column, rule: Column, line: Column, commit: Column) -> Column:
    """file:rule:line, after the commit if there is one."""
    plain = F.concat_ws(":", file, rule, line)
    return F.when(F.coalesce(F.length(commit), F.lit(0)) > 0, F.concat_ws(":", commit, plain)).otherwise(plain)


def masked_secret(secret: Column, percent: int) -> Column:
    """The first part of a secret and "...": what ``percent`` leaves of its bytes, halves to even; 100 and more: a word.

    An empty secret stays empty. The bytes are cut at characters, so that the result is text.
    """
    if percent >= 100:
        return F.when(F.length(secret) == 0, secret).otherwise(F.lit("REDACTED"))
    keep = F.bround(F.octet_length(secret) * F.lit((100 - percent) / 100.0), 0).cast("int")
    return F.when(F.length(secret) == 0, secret).otherwise(F.concat(F.substring(secret, F.lit(1), keep), F.lit("...")))


def redacted(text: Column, secret: Column, percent: int) -> Column:
    """``text`` with every occurrence of ``secret`` masked."""
    return F.when(F.length(secret) == 0, text).otherwise(F.replace(text, secret, masked_secret(secret, percent)))


def has_allow_marker(line: Column) -> Column:
    return F.contains(line, F.lit(ALLOW_MARKERS[0])) | F.contains(line, F.lit(ALLOW_MARKERS[1]))


def location(content: Column, start: Column, end: Column, first_line: Column) -> Column:
    """Lines and columns of the bytes start to end of ``content``, as the finding table has them: a struct of start_line,
    end_line, start_column, end_column and line, in which each part of the text is cut and counted once.

    Lines count from ``first_line``. Columns count from 1 on the first line; on later ones from the line feed before, so they
    are one higher. A match beyond the last line feed has a line text from the text's start to the next CR or LF; one
    that crosses the last line feed ends on its own line in column 0. The line's text begins with its line feed.
    """
    feeds = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit("\n")))
    part = lambda x: F.struct(feeds(x).alias("feeds"), F.when(F.contains(x, F.lit("\n")), F.octet_length(x) - F.octet_length(F.substring_index(x, "\n", -1)) - 1).otherwise(0).alias("last"))

    def counted(raw: Column) -> Column:
        cut = lambda a, n: F.substring(raw, a + 1, n).cast("string")
        before, upto = let(cut(F.lit(0), start), part), let(cut(F.lit(0), end), part)
        after = let(cut(end, F.octet_length(raw)), lambda x: F.struct(x.alias("text"), feeds(x).alias("feeds")))
        return let(F.struct(before.alias("before"), upto.alias("upto"), after.alias("after"), (F.substring(raw, start + 1, F.lit(1)) == F.lit("\n").cast("binary")).alias("at_start")), lambda p: placed(raw, p))

    def placed(raw: Column, p: Column) -> Column:
        before, upto, after, at_start = p["before"], p["upto"], p["after"], p["at_start"]
        first = before["feeds"] + F.when(at_start, 1).otherwise(0)
        total = feeds(content)
        none = total == 0
        tail = (first >= total) & ~none  # beyond the last line feed
        crossing = ~tail & ~none & (after["feeds"] == 0)
        feed = F.when(at_start, start).otherwise(before["last"])  # a match's own first line feed counts as the one before it
        return let(F.struct(first.alias("first"), none.alias("none"), tail.alias("tail"), crossing.alias("crossing"), feed.alias("feed")), lambda q: told(raw, upto, after["text"], q))

    def told(raw: Column, upto: Column, after: Column, q: Column) -> Column:
        open_, feed = q["tail"] | q["none"], q["feed"]
        end_column = F.when(q["crossing"], F.lit(0)).otherwise(end - F.when(open_, feed).otherwise(upto["last"]))
        end_line = F.when(open_ | q["crossing"], q["first"]).otherwise(upto["feeds"])
        line_from = F.when(open_, 0).otherwise(feed)
        rest = F.when(open_, F.element_at(F.split(after, "[\r\n]", 2), 1)).otherwise(F.substring_index(after, "\n", 1))
        line = F.concat(F.substring(raw, line_from + 1, end - line_from).cast("string"), rest)
        return F.struct(
            (q["first"] + first_line).cast("int").alias("start_line"), (end_line + first_line).cast("int").alias("end_line"), (start - feed + 1).cast("int").alias("start_column"),
            end_column.cast("int").alias("end_column"), line.alias("line"),
        )

    return let(content.cast("binary"), counted)


#: Bytes up to which a match's line is taken from the text's lines; a longer one is cut from the whole text.
_LONG = 4096


def match_places(content: Column, parts: Column) -> Column:
    """Of ``parts`` (gap, m: a text cut into gaps and the matches after them, null after the last; match: m without line feeds
    at its edges; secret) the places of the matches: structs of m, match, secret, start, end (of the match without line feeds at its edges, counted from its start), before and upto (line
    feeds before these places), total (all of them), below, above, next (places of the last line feed before each, and of
    the first one from the end on), line (the line's text) or, if that is long or the last line, text (the whole).

    All are sums over the parts and over the lines, so that a text takes time in proportion to its size and its matches,
    and no match carries the text but those in long lines.
    """
    feeds = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit("\n")))
    size = lambda x: F.coalesce(F.octet_length(x), F.lit(0))
    ends = running_sum(F.transform(parts, lambda p: F.octet_length(p["gap"]) + size(p["m"])))
    counts = running_sum(F.transform(parts, lambda p: feeds(p["gap"]) + F.coalesce(feeds(p["m"]), F.lit(0))))

    def one(p: Column, i: Column, e: Column, n: Column, x: Column, a: Column) -> Column:
        start, before = F.get(e, i) - size(p["m"]), F.get(n, i) - feeds(p["m"])
        inside = F.substring(p["m"].cast("binary"), F.lit(1), F.octet_length(p["match"])).cast("string")
        upto, total = before + feeds(inside), F.size(a) - 1
        place = lambda k: F.when(k > 0, F.get(a, k - 1)).otherwise(0)
        first = before + F.when(F.startswith(p["m"], F.lit("\n")), 1).otherwise(0)
        short = (first < total) & (F.get(a, upto) - place(before) <= _LONG)
        line = F.concat(F.when(first > 0, "\n").otherwise(""), F.array_join(F.slice(x, first + 1, F.greatest(upto - first + 1, F.lit(0))), "\n"))
        return F.struct(
            p["m"].alias("m"), p["match"].alias("match"), p["secret"].alias("secret"), start.alias("start"), (start + F.octet_length(inside)).alias("end"), before.alias("before"), upto.alias("upto"), total.alias("total"), place(before).alias("below"),
            place(upto).alias("above"), F.get(a, upto).alias("next"), F.when(short, line).alias("line"), F.when(~short, content).alias("text"),
        )

    def placed(e: Column, n: Column, x: Column) -> Column:
        # where line feeds stand: each ends a line, but for the last one
        at = F.transform(running_sum(F.transform(x, lambda y: F.octet_length(y) + 1)), lambda y: y - 1)
        return let(at, lambda a: F.transform(F.filter(parts, lambda p: p["m"].isNotNull()), lambda p, i: one(p, i, e, n, x, a)))

    return let(ends, lambda e: let(counts, lambda n: let(F.split(content, "\n", -1), lambda x: placed(e, n, x))))


def match_starts(content: Column, parts: Column) -> Column:
    """m, match, secret and start of ``match_places`` alone, for matches that are located otherwise."""
    ends = running_sum(F.transform(parts, lambda p: F.octet_length(p["gap"]) + F.coalesce(F.octet_length(p["m"]), F.lit(0))))
    one = lambda p, end: F.struct(p["m"].alias("m"), p["match"].alias("match"), p["secret"].alias("secret"), (end - F.octet_length(p["m"])).alias("start"))
    return let(ends, lambda e: F.transform(F.filter(parts, lambda p: p["m"].isNotNull()), lambda p, i: one(p, F.get(e, i))))


def match_location(place: Column, first_line: Column) -> dict[str, Column]:
    """What ``location`` tells, from a struct of ``match_places``."""
    start, end, total, text = place["start"], place["end"], place["total"], place["text"]
    at_start = F.startswith(place["m"], F.lit("\n"))
    first = place["before"] + F.when(at_start, 1).otherwise(0)
    none = total == 0
    tail = (first >= total) & ~none
    crossing = ~tail & ~none & (place["upto"] >= total)
    feed = F.when(at_start, start).otherwise(place["below"])
    cut = lambda a, b: F.substring(text.cast("binary"), a + 1, b - a).cast("string")
    rest = F.element_at(F.split(cut(end, F.octet_length(text)), "[\r\n]", 2), 1)
    return {
        "start_line": (first + first_line).cast("int"),
        "end_line": (F.when(none | tail | crossing, first).otherwise(place["upto"]) + first_line).cast("int"),
        "start_column": (start - feed + 1).cast("int"),
        "end_column": F.when(crossing, F.lit(0)).otherwise(end - F.when(tail | none, feed).otherwise(place["above"])).cast("int"),
        "line": F.when(place["line"].isNotNull(), place["line"]).when(tail | none, F.concat(cut(F.lit(0), end), rest)).otherwise(cut(feed, place["next"])),
    }


def github_pat_state(secret: Column) -> Column:
    """Offline layout check of a classic personal access token: valid, invalid or unknown."""
    return F.when(secret.rlike(r"\Aghp_[A-Za-z0-9]{36}\z"), "valid").when(F.startswith(secret, F.lit("ghp_")), "invalid").otherwise("unknown")


def scm_link(platform: Column, remote: Column, commit: Column, file: Column, first: Column, last: Column) -> Column:
    """The address of lines in a hosted repository; null without a commit or on an unknown platform.

    Paths escape "%" and " "; of an archive member the outer path is linked, without lines. Rendered Markdown is asked for
    as source.
    """
    outer, member = F.substring_index(file, "!", 1), F.contains(file, F.lit("!"))
    path = F.replace(F.replace(outer, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    plain = F.lower(outer).rlike(r"\.(?:md|markdown|ipynb)\z")
    one = last <= first
    lines = lambda a, b: F.when(member, "").when(one, F.concat(F.lit(a), first)).otherwise(F.concat(F.lit(a), first, F.lit(b), last))
    url = (
        F.when(platform == "github", F.concat(remote, F.lit("/blob/"), commit, F.lit("/"), path, F.when(plain, "?plain=1").otherwise(""), lines("#L", "-L")))
        .when(platform == "gitlab", F.concat(remote, F.lit("/blob/"), commit, F.lit("/"), path, F.when(plain, "?plain=1").otherwise(""), lines("#L", "-")))
        .when(platform == "gitea", F.concat(remote, F.lit("/src/commit/"), commit, F.lit("/"), path, F.when(plain, "?display=source").otherwise(""), lines("#L", "-L")))
        .when(platform == "bitbucket", F.concat(remote, F.lit("/src/"), commit, F.lit("/"), path, F.when(plain, "?mode=view").otherwise(""), lines("#lines-", ":")))
        .when(platform == "azuredevops", F.concat(remote, F.lit("/commit/"), commit, F.lit("?path=/"), path, F.when(member, "").otherwise(F.concat(F.lit("&line="), first, F.lit("&lineEnd="), last + 1, F.lit("&lineStartColumn=1&lineEndColumn=1&lineStyle=plain&_a=contents")))))
    )
    return F.when(F.length(commit) > 0, url)


def scm_remote(remote: Column) -> tuple[Column, Column]:
    """The platform and the web address of a Git remote: scp-like and ssh addresses become https, credentials and a final
    ".git" go. The platform is told by the host; unknown ones are null."""
    scp = F.regexp_extract(remote, r"^(?:[^@/:]+@)?([^/:]+):(?!/)(.+)$", 1)
    path = F.regexp_extract(remote, r"^(?:[^@/:]+@)?([^/:]+):(?!/)(.+)$", 2)
    web = F.when(F.length(scp) > 0, F.concat(F.lit("https://"), scp, F.lit("/"), path)).otherwise(F.regexp_replace(remote, r"^(?:ssh|git|https?)://(?:[^@/]*@)?([^/:]+)(?::\d+)?/", "https://$1/"))
    web = F.regexp_replace(web, r"(?:\.git)?/*$", "")
    host = F.regexp_extract(web, r"^https://([^/]+)", 1)
    platform = F.when(host.rlike(r"(?:^|\.)github\."), "github").when(host.rlike(r"(?:^|\.)gitlab\."), "gitlab").when(host.rlike(r"(?:^|\.)(?:gitea|codeberg)\."), "gitea").when(host.rlike(r"(?:^|\.)bitbucket\."), "bitbucket").when(host.rlike(r"(?:^|\.)(?:dev\.azure|visualstudio)\."), "azuredevops")
    return platform, web


def without_secrets(text: Column, secrets: Column) -> Column:
    """``text`` without any of ``secrets`` (an array), the longest first."""
    by_length = F.array_sort(F.filter(secrets, lambda s: F.length(s) > 0), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(by_length, text, lambda acc, s: F.replace(acc, s, F.lit("")))


def segment_matches(secret: Column, pattern: str, most: int = 4096) -> Column:
    """Whether the second of exactly three parts of ``secret`` (cut at dots) is base64url for text of at most ``most``
    bytes that ``pattern`` (of java.util.regex) matches whole."""
    part = F.get(F.split(secret, r"\."), F.lit(1))
    standard = F.translate(part, "-_", "+/")
    padded = F.rpad(standard, F.length(standard) + F.pmod(-F.length(standard), F.lit(4)), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64"))
    good = (F.size(F.split(secret, r"\.")) == 3) & part.rlike(r"\A[A-Za-z0-9_-]+\z") & (F.octet_length(decoded) <= most)
    return F.coalesce(good & F.decode(decoded, "UTF-8").rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def version_at_least(version: str, least: str) -> bool:
    """Versions of dotted numbers; a leading v, and what follows + or -, don't count."""
    parts = lambda v: [int(x) for x in v.strip().removeprefix("v").split("+")[0].split("-")[0].split(".")]
    a, b = parts(version), parts(least)
    n = max(len(a), len(b))
    return a + [0] * (n - len(a)) >= b + [0] * (n - len(b))
