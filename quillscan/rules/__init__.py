"""Rule sets: TOML with weak types, extension, merging, selection and validation."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from quillscan.functions.dialect import PatternError, group_count, to_java
from quillscan.rules import families

MAX_DEPTH, MAX_RULES = 2, 4096


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Allowlist:
    description: str = ""
    condition: str = "OR"
    commits: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    regex_target: str = "secret"
    regexes: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    target_rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class Required:
    """``lines`` and ``columns`` bound the distance of the starts (negative: never). ``relation``: proximity,
    same-candidate or window (the helper's start within so many lines of the whole match; 0: anywhere)."""

    id: str
    lines: int | None = None
    columns: int | None = None
    relation: str = "proximity"


@dataclass(frozen=True)
class Rule:
    id: str
    description: str = ""
    regex: str = ""
    path: str = ""
    secret_group: int = 0
    entropy: float = 0.0
    byte_entropy: tuple[str, float] | None = None
    keywords: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    allowlists: tuple[Allowlist, ...] = ()
    required: tuple[Required, ...] = ()
    skip_report: bool = False

    @property
    def java(self) -> str:
        return to_java(self.regex)

    @property
    def groups(self) -> int:
        return group_count(self.regex) if self.regex else 0


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    allowlists: tuple[Allowlist, ...] = ()
    title: str = ""
    disabled: tuple[str, ...] = field(default=(), compare=False)

    def rule(self, name: str) -> Rule:
        return next(r for r in self.rules if r.id == name)

    def select(self, names: list[str]) -> RuleSet:
        """The named rules, with the helpers that they require."""
        if missing := set(names) - {r.id for r in self.rules}:
            raise ConfigError(f"no such rule: {sorted(missing)}")
        wanted, todo = set(), list(names)
        while todo:
            if (x := todo.pop()) not in wanted:
                wanted.add(x)
                todo += [q.id for q in self.rule(x).required]
        return replace(self, rules=tuple(r if r.id in names else replace(r, skip_report=True) for r in self.rules if r.id in wanted))


def _text(x: object) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def _list(x: object) -> list:
    return [] if x is None else [p.strip() for p in x.split(",")] if isinstance(x, str) and "," in x else [*x] if isinstance(x, list) else [x]


def _int(x: object) -> int | None:
    return None if x is None else int(x, 0) if isinstance(x, str) else int(x)


def _bool(x: object) -> bool:
    return x.lower() in ("1", "t", "true") if isinstance(x, str) else bool(x)


def _lowered(x: object) -> object:
    if isinstance(x, dict):
        return {k.lower(): _lowered(v) for k, v in x.items()}
    return [_lowered(v) for v in x] if isinstance(x, list) else x


def _checked(pattern: str, where: str) -> str:
    try:
        to_java(pattern)
    except PatternError as e:
        raise ConfigError(f"{where}: {e}") from None
    return pattern


def _allowlist(x: dict, where: str) -> Allowlist:
    condition = _text(x.get("condition")).upper()
    if condition not in ("", "OR", "||", "AND", "&&"):
        raise ConfigError(f"{where}: unknown condition {condition}")
    target = _text(x.get("regextarget")) or "secret"
    if target not in ("secret", "match", "line"):
        raise ConfigError(f"{where}: unknown regexTarget {target}")
    found = Allowlist(
        _text(x.get("description")), "AND" if condition in ("AND", "&&") else "OR",
        tuple(_text(c).strip().lower() for c in _list(x.get("commits"))), tuple(_checked(_text(p), where) for p in _list(x.get("paths"))), target,
        tuple(_checked(_text(p), where) for p in _list(x.get("regexes"))), tuple(w.lower() for w in map(_text, _list(x.get("stopwords"))) if w), tuple(map(_text, _list(x.get("targetrules")))),
    )
    if not (found.commits or found.paths or found.regexes or found.stopwords):
        raise ConfigError(f"{where}: an empty allowlist")
    return found


def _allowlists(x: dict, where: str) -> tuple[Allowlist, ...]:
    old, new = x.get("allowlist"), x.get("allowlists")
    if old is not None and new is not None:
        raise ConfigError(f"{where}: both allowlist and allowlists")
    return tuple(_allowlist(a, where) for a in _list(new if new is not None else old))


def _rule(x: dict) -> Rule:
    name = _text(x.get("id"))
    if not name:
        raise ConfigError("a rule without an id")
    regex, path = _text(x.get("regex")), _text(x.get("path"))
    required = tuple(Required(_text(q.get("id")), _int(q.get("withinlines")), _int(q.get("withincolumns")), _text(q.get("relation")) or "proximity") for q in _list(x.get("required")))
    algorithm = None
    if x.get("byteentropy") is not None:
        algorithm = (_text(x.get("entropyreject")) or "lt", float(x["byteentropy"]))
    return Rule(
        name, _text(x.get("description")), _checked(regex, name) if regex else "", _checked(path, name) if path else "", _int(x.get("secretgroup")) or 0, float(x.get("entropy") or 0), algorithm,
        tuple(_text(k).lower() for k in _list(x.get("keywords"))), tuple(map(_text, _list(x.get("tags")))), _allowlists(x, name), required, _bool(x.get("skipreport", False)),
    )


def load(text: str, resolve: Callable[[str], str] | None = None, default: str | None = None, depth: int = 0) -> RuleSet:
    """A rule set from TOML. ``resolve`` reads the file that [extend] path names, ``default`` is what useDefault means;
    an extension beyond the second level is passed over."""
    x = _lowered(tomllib.loads(text))
    # [families] builtin: the rules that are built from parameters come first
    built = families.rules() if _bool((x.get("families") or {}).get("builtin", False)) else []
    rules = [_rule(r) for r in [*built, *_list(x.get("rules"))]]
    if len({r.id for r in rules}) < len(rules):
        raise ConfigError("two rules of one id")
    own = RuleSet(tuple(rules), _allowlists(x, "global"), _text(x.get("title")))
    extend = x.get("extend") or {}
    if extend.get("path") and _bool(extend.get("usedefault", False)):
        raise ConfigError("extend: both path and useDefault")
    if depth < MAX_DEPTH and (extend.get("path") or _bool(extend.get("usedefault", False))):
        if extend.get("path"):
            source = (resolve or (lambda p: Path(p).read_text()))(_text(extend["path"]))
        else:
            source = default if default is not None else default_pack()
        own = merge(load(source, resolve, default, depth + 1), own, [_text(d) for d in _list(extend.get("disabledrules"))])
    return _validated(own) if depth == 0 else own


def merge(base: RuleSet, over: RuleSet, disabled: list[str]) -> RuleSet:
    """``over`` upon ``base``: fields that it sets replace, lists append (the base's first), other rules are added."""
    rules = {r.id: r for r in base.rules if r.id not in disabled}
    for r in over.rules:
        if b := rules.get(r.id):
            rules[r.id] = replace(
                b, description=r.description or b.description, regex=r.regex or b.regex, path=r.path or b.path, secret_group=r.secret_group or b.secret_group, entropy=r.entropy or b.entropy,
                keywords=b.keywords + r.keywords, tags=b.tags + r.tags, allowlists=b.allowlists + r.allowlists,
            )
        else:
            rules[r.id] = r
    return RuleSet(tuple(rules.values()), base.allowlists + over.allowlists, over.title or base.title)


def _validated(s: RuleSet) -> RuleSet:
    ids = {r.id for r in s.rules}
    if len(ids) > MAX_RULES:
        raise ConfigError("too many rules")
    attached: dict[str, list[Allowlist]] = {}
    for a in s.allowlists:
        for t in a.target_rules:
            if t not in ids:
                raise ConfigError(f"targetRules: no rule {t}")
            attached.setdefault(t, []).append(a)
    rules = []
    for r in s.rules:
        if not r.regex and not r.path:
            raise ConfigError(f"{r.id}: neither regex nor path")
        if r.secret_group > r.groups:
            raise ConfigError(f"{r.id}: secretGroup over {r.groups}")
        for q in r.required:
            if q.id not in ids:
                raise ConfigError(f"{r.id}: requires an unknown rule {q.id}")
        rules.append(replace(r, allowlists=r.allowlists + tuple(attached.get(r.id, ()))))
    return replace(s, rules=tuple(sorted(rules, key=lambda r: r.id)), allowlists=tuple(a for a in s.allowlists if not a.target_rules))


def allowed_by(a: Allowlist) -> tuple[str, ...]:
    """Which of an allowlist's parts are set."""
    return tuple(k for k in ("commits", "paths", "regexes", "stopwords") if getattr(a, k))


def joined(patterns: tuple[str, ...]) -> str:
    """Patterns as one alternation; they aren't isolated from each other, so a flag reaches those after it."""
    return "(?:" + "|".join(patterns) + ")" if patterns else ""


def default_pack() -> str:
    return (Path(__file__).parent / "pack.toml").read_text()


def default_rules() -> RuleSet:
    return load(default_pack())


_SAFE = re.compile(r"[A-Za-z0-9_.:/-]+")
