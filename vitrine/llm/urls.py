"""URL filter: a weighted vocabulary found by Aho-Corasick, under host rules.

Terms are strict or soft, and soft ones have weights.  One automaton finds all of
them in one pass over a lower-cased URL; a hit counts only between boundaries (no
ASCII letter or digit next to it).  One strict hit blocks, and so do two or more
different soft ones whose weights reach ``soft_limit``.  Host rules come first: a
rule fits a host and all its subdomains where the path starts with the rule's
path, and the longest rule wins.  The vocabulary is an argument; ``read_vocabulary``
takes it from a table of any size up to a bound.

Scale: one pass over the URL column alone (the pages' texts are not read), no
shuffle; the automaton is of the vocabulary's size, built once per task.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
is judged by the vocabulary (a null one is allowed); empty tables give empty
results; repeated rows are judged alike; ports and user names stay part of the
host; very long URLs are searched whole; all columns of the input are kept, and
the results stand in one struct column next to them (which replaces a column of
its own name only).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = ("spam-farm", "cheap-pills", "porn", "xxx", "phishing", "malware", "warez")
SOFT = ("casino", "poker", "betting", "viagra", "pills", "payday", "loans", "cheap", "spam", "farm", "free", "winner", "prize", "adult", "dating", "crack", "torrent")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the queries use.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Vocabulary:
    """Strict terms, and soft terms with their weights, all lower-case."""

    strict: tuple[str, ...]
    soft: tuple[tuple[str, float], ...]


#: The vocabulary that the queries use: every soft term weighs 1.
VOCABULARY = Vocabulary(STRICT, tuple((t, 1.0) for t in SOFT))


def read_vocabulary(terms: DataFrame, most: int = 1_000_000) -> Vocabulary:
    """A vocabulary from a table (term, strict, weight) of at most so many different terms; null and empty terms don't count, a null weight is 1, of repeated terms the strict or heaviest one counts."""
    clean = terms.select(F.translate("term", UPPER, LOWER).alias("term"), F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("weight", F.lit(1.0)).alias("weight")).where("term <> ''")
    rows = clean.groupBy("term").agg(F.max("strict").alias("strict"), F.max("weight").alias("weight")).orderBy("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary has at most {most} terms")
    return Vocabulary(tuple(r.term for r in rows if r.strict), tuple((r.term, r.weight) for r in rows if not r.strict))


def automaton(vocabulary: Vocabulary):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in vocabulary.soft:
        found.add_word(term, (term, weight))
    for term in vocabulary.strict:
        found.add_word(term, (term, None))
    found.make_automaton()
    return found


def term_hits(machine, url: str) -> tuple[list[str], list[str], float]:
    """The different strict and soft terms that stand between boundaries in a lower-cased URL, and the soft ones' weight."""
    strict, soft = set(), {}
    free = lambda c: not (c.isascii() and c.isalnum())
    for end, (term, weight) in machine.iter(url) if len(machine) else ():
        start = end - len(term) + 1
        if (start == 0 or free(url[start - 1])) and (end + 1 == len(url) or free(url[end + 1])):
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
    return sorted(strict), sorted(soft), float(sum(soft.values()))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = VOCABULARY, soft_limit: float = 2, out: str = "judged") -> DataFrame:
    """Add column ``out``: host, path, rule (its name, or null), verdict (allow or block), strict_terms, soft_terms, soft_weight."""

    @F.pandas_udf("struct<strict:array<string>,soft:array<string>,weight:double>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(vocabulary)
        for urls in batches:
            hits = [term_hits(machine, u) for u in urls]
            yield pd.DataFrame({"strict": [h[0] for h in hits], "soft": [h[1] for h in hits], "weight": [h[2] for h in hits]})

    host, path = host_and_path(F.col(url))
    low = F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER)
    # the caller's columns stand apart, whatever their names
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("given"), host.alias("host"), path.alias("path"), terms(low).alias("hits"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        rule, ruled = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(ruled)
    by_terms = F.when((F.size("hits.strict") > 0) | (F.size("hits.soft") >= 2) & (F.col("hits.weight") >= soft_limit), "block").otherwise("allow")
    judged = F.struct("host", "path", rule.alias("rule"), F.coalesce(ruled, by_terms).alias("verdict"), F.col("hits.strict").alias("strict_terms"), F.col("hits.soft").alias("soft_terms"), F.col("hits.weight").alias("soft_weight"))
    return df.select(*[F.col("given")[c].alias(c) for c in pages.columns if c != out], judged.alias(out))


def oracle(rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = 2) -> str:
    """The same for the table pages, as DuckDB SQL."""
    has = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT"
    ordered = sorted(rules, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    return f"""
    WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
                      CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
    SELECT page_id, host, path,
           CASE {' '.join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ordered)} END AS rule,
           CASE {' '.join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)}
                WHEN {' + '.join(map(has, strict))} > 0 OR {' + '.join(map(has, soft))} >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict
    FROM b"""
