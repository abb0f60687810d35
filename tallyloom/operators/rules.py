"""Ordered keyword rules over short texts: the first rule that holds names the class."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import keyword_pattern


@dataclass(frozen=True)
class Rule:
    """A class with clauses; an empty clause holds. Case-sensitive rules read the raw text, the others the clean one."""

    name: str
    any_of: tuple = ()
    all_of: tuple = ()
    none_of: tuple = ()
    regex_any_of: tuple = ()
    regex_none_of: tuple = ()
    exact_any_of: tuple = ()
    case_sensitive: bool = False


@dataclass(frozen=True)
class RuleSet:
    """Rules in order, with named groups of words ($NAME in a clause stands for its words) and vetoes.

    vetoes: class prefix -> (any_of, all_of, none_of) that a text of such a class must meet, else it loses the class.
    """

    rules: tuple
    groups: dict = field(default_factory=dict)
    vetoes: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> RuleSet:
        """From the parsed form of a rule file: market_rules, keyword_groups, required_keywords."""
        known = set(Rule.__dataclass_fields__)
        rules = []
        for r in d.get("market_rules", []):
            if set(r) - known:
                raise KeyError(f"unknown clauses {sorted(set(r) - known)} in {r.get('name')}")
            rules.append(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}))
        vetoes = {k: tuple(tuple(v.get(c, ())) for c in ("any_of", "all_of", "none_of")) for k, v in d.get("required_keywords", {}).items()}
        return cls(tuple(rules), dict(d.get("keyword_groups", {})), vetoes)

    def words(self, clause: tuple) -> list[str]:
        out = []
        for w in clause:
            if w.startswith("$"):
                if w[1:] not in self.groups:
                    raise KeyError(f"no keyword group {w}")
                out += self.groups[w[1:]]
            else:
                out.append(w)
        return out


class Engine:
    """A rule set compiled once; equal inputs are answered from a bounded memory."""

    def __init__(self, rules: RuleSet):
        c = lambda words, case=False: re.compile(keyword_pattern(words, case=case)) if words else None
        self.rules = []
        for r in rules.rules:
            any_of = [c(rules.words(r.any_of), r.case_sensitive)] if r.any_of else []
            all_of = [c(rules.words((w,)), r.case_sensitive) for w in r.all_of]
            none_of = [c(rules.words(r.none_of), r.case_sensitive)] if r.none_of else []
            flags = 0 if r.case_sensitive else re.I
            regex_any = [re.compile("|".join(f"(?:{p})" for p in r.regex_any_of), flags)] if r.regex_any_of else []
            regex_none = [re.compile("|".join(f"(?:{p})" for p in r.regex_none_of), flags)] if r.regex_none_of else []
            self.rules.append((r.name, r.case_sensitive, any_of + all_of + regex_any, none_of + regex_none, frozenset(x.lower() for x in rules.words(r.exact_any_of))))
        self.vetoes = [(k, c(rules.words(a)), [c(rules.words((w,))) for w in b], c(rules.words(n))) for k, (a, b, n) in rules.vetoes.items()]
        self.classify = lru_cache(maxsize=100_000)(self._classify)

    def _classify(self, clean: str, raw: str) -> str | None:
        for name, case, need, never, exact in self.rules:
            text = raw if case else clean
            if exact and clean.strip().lower() not in exact:
                continue
            if not (need or exact or never):
                continue
            if all(p.search(text) for p in need) and not any(p.search(text) for p in never):
                return name if self._allowed(name, clean) else None
        return None

    def _allowed(self, name: str, text: str) -> bool:
        for prefix, any_of, all_of, none_of in self.vetoes:
            if name.startswith(prefix) and ((any_of and not any_of.search(text)) or not all(p.search(text) for p in all_of) or (none_of and none_of.search(text))):
                return False
        return True


_engines: dict = {}


def classify(df: DataFrame, rules: RuleSet, key: str, clean: str, raw: str) -> DataFrame:
    """(key, rule): the class of each row, null if no rule holds or a veto takes it. Null texts read as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Engine(rules)
        for f in frames:
            yield pd.DataFrame({key: f[key], "rule": [e.classify(a or "", b or "") for a, b in zip(f["__clean"], f["__raw"], strict=True)]})

    return df.select(key, F.col(clean).alias("__clean"), F.col(raw).alias("__raw")).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, rule string")


def hybrid(anti: Column, seed: Column, score: Column, *, prior: Column | None = None, prior_n: Column | None = None, cut: float = 0.5, least_n: int = 20, low: float = 0.05, high: float = 0.99) -> Column:
    """1 or 0: anti-seeds give 0, then seeds 1, then the model's score; a supplier's strong prior overrides what no seed forced."""
    f = lambda c: F.coalesce(c, F.lit(False))
    model = F.when(F.coalesce(score, F.lit(0.0)) >= cut, 1).otherwise(0)
    if prior is not None:
        sure = f(prior_n >= least_n)
        model = F.when(sure & f(prior <= low), 0).when(sure & f(prior >= high), 1).otherwise(model)
    return F.when(f(anti), 0).when(f(seed), 1).otherwise(model)


def cascade(stages: list[tuple[str, Column, Column]], default: Column) -> tuple[Column, Column]:
    """(value, source) of ordered stages (name, condition, value): the first whose condition is true decides."""
    value, source = None, None
    for name, cond, v in stages:
        cond = F.coalesce(cond, F.lit(False))
        value = F.when(cond, v) if value is None else value.when(cond, v)
        source = F.when(cond, F.lit(name)) if source is None else source.when(cond, F.lit(name))
    return value.otherwise(default), source.otherwise(F.lit("default"))
