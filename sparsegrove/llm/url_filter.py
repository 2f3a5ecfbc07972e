"""URL filter: domain rules first, then a weighted vocabulary counted by Aho-Corasick.

A rule names a host (it and its subdomains) and the start of a path; of the rules that fit the longest wins.
A url that no rule fits is judged by its words: one automaton finds all terms of the vocabulary in one pass
over the lower-cased, percent-decoded url.  A term is any text, of one word or several; one with the boundary
``word`` counts only between signs that are neither letters nor digits (or an end), one with ``any`` wherever it
stands.  Terms weigh ``STRICT`` (one hit rejects) or less (soft): distinct soft terms add up and reject when
their weights reach the limit.

The vocabulary is a table (term, weight, boundary): the file ``url_terms.tsv`` beside this module, or any
DataFrame with these columns (``terms_of``); it is read on the driver, at most ``MOST_TERMS`` terms.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed unless their words
reject them.  Each row is judged by itself, so ties, repeated rows and further columns make no difference.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, need, on_workers

STRICT = 1.0
#: Distinct soft terms reject when their weights reach this.
LIMIT = 1.0
#: (verdict, host, path) by the query's contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A vocabulary reaches every task, so it is bounded.
MOST_TERMS = 1_000_000


def file_terms(path: str | None = None) -> dict[str, tuple[float, str]]:
    """Term to (weight, boundary), from a table with tabs and a header; without a path from the one of this package."""
    text = pkgutil.get_data(__package__, "url_terms.tsv").decode() if path is None else Path(path).read_text("utf-8")
    rows = [x.split("\t") for x in text.splitlines()[1:] if x]
    return {t.lower(): (float(w), b) for t, w, b in rows}


def terms_of(vocabulary: DataFrame) -> dict[str, tuple[float, str]]:
    """The same from a DataFrame (term, weight, boundary); a repeated term has its largest weight, null terms go."""
    rows = need(vocabulary, term="string", weight="double", boundary="string").where("term <> '' AND weight IS NOT NULL").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the vocabulary has more than {MOST_TERMS} terms")
    return {x["term"].lower(): (x["weight"], x["boundary"] or "word") for x in sorted(rows, key=lambda x: x["weight"])}


VOCABULARY = file_terms()

COLUMNS = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double"
SCHEMA = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict")), ("strict_hits", pa.int32()), ("soft_hits", pa.int32()), ("soft_weight", pa.float64())])

_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[: end if slash < 0 else slash]
    return host.translate(_LOWER), "" if slash < 0 else rest[slash:end]


class Rules:
    """The longest fitting rule: one dictionary probe for each suffix of the host."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and len(rule) > len(best[0] or ""):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best


class Vocabulary:
    def __init__(self, terms: dict[str, tuple[float, str]]):
        import ahocorasick

        self.terms = terms
        self.automaton = ahocorasick.Automaton()
        for t in terms:
            self.automaton.add_word(t, t)
        if terms:
            self.automaton.make_automaton()

    def count(self, url: str | None) -> tuple[int, int, float]:
        """Strict hits, distinct soft terms and their weight."""
        if not url or not self.terms:
            return 0, 0, 0.0
        text = (unquote(url) if "%" in url else url).lower()
        strict, soft = 0, set()
        for end, term in self.automaton.iter(text):
            start = end + 1 - len(term)
            weight, boundary = self.terms[term]
            if boundary == "word" and ((start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum())):
                continue
            if weight >= STRICT:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft), round(sum(self.terms[t][0] for t in sorted(soft)), 6)


def judge_batches(batches: Iterator[pa.RecordBatch], rules, terms: dict[str, tuple[float, str]], limit: float) -> Iterator[pa.RecordBatch]:
    rule_set, vocabulary = Rules(rules), Vocabulary(terms)
    for b in batches:
        hosts, paths, found, verdicts, strict, soft, weight = [], [], [], [], [], [], []
        for url in b.column(1).to_pylist():
            host, path = split_url(url)
            rule, verdict = rule_set.find(host, path)
            hits = vocabulary.count(url)
            hosts.append(host)
            paths.append(path)
            found.append(rule)
            verdicts.append(verdict or ("block" if hits[0] or hits[2] >= limit else "allow"))
            for out, x in zip((strict, soft, weight), hits):
                out.append(x)
        yield batch(SCHEMA, b.column(0), hosts, paths, found, verdicts, np.array(strict, np.int32), np.array(soft, np.int32), np.array(weight, float))


def judge_urls(pages: DataFrame, rules=RULES, terms: dict[str, tuple[float, str]] | None = None, limit: float = LIMIT) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url); no shuffle."""
    rows = need(pages, page_id="long", url="string")
    return rows.mapInArrow(on_workers(__name__, "judge_batches", rules, VOCABULARY if terms is None else terms, limit), COLUMNS)


def oracle(rules=RULES, terms: dict[str, tuple[float, str]] = VOCABULARY, limit: float = LIMIT) -> str:
    """The query in SQL; a term that overlaps itself would be counted otherwise, the file has none."""
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    by_rule = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in longest) + " END"
    # every sign stands between two bars, so a term between bars stands between boundaries
    values = ", ".join(f"('{t}', CAST({w} AS DOUBLE), '{b}')" for t, (w, b) in terms.items())
    return f"""
WITH parts AS (SELECT row_number() OVER () AS k, page_id, url, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS rest FROM pages),
hosts AS (SELECT k, page_id, url, translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE coalesce(rest, '') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM parts),
ruled AS (SELECT *, {rule} AS rule FROM hosts),
vocabulary(term, weight, boundary) AS (VALUES {values}),
plain AS (SELECT k, lower(url_decode(coalesce(url, ''))) AS url FROM hosts),
marked AS (SELECT k, url, '|' || regexp_replace(url, '([^\\pL\\pN])', '|\\1|', 'g') || '|' AS words FROM plain),
bounded AS (SELECT term, weight, boundary, '|' || regexp_replace(term, '([^\\pL\\pN])', '|\\1|', 'g') || '|' AS words FROM vocabulary),
counted AS (SELECT m.k, v.term, v.weight,
  CASE v.boundary WHEN 'word' THEN contains(m.words, v.words) ELSE contains(m.url, v.term) END AS hit,
  CASE v.boundary WHEN 'word' THEN len(string_split(m.words, v.words)) - 1 ELSE len(string_split(m.url, v.term)) - 1 END AS times FROM marked m JOIN bounded v ON contains(m.url, v.term)),
hits AS (SELECT k, term, weight, times AS n FROM counted WHERE hit),
summed AS (SELECT k, coalesce(sum(n) FILTER (weight >= {STRICT}), 0) AS strict_hits, count(*) FILTER (weight < {STRICT}) AS soft_hits, coalesce(round(sum(weight) FILTER (weight < {STRICT}), 6), 0) AS soft_weight FROM hits GROUP BY k)
SELECT r.page_id, host, path, rule, coalesce({by_rule}, CASE WHEN coalesce(strict_hits, 0) > 0 OR coalesce(soft_weight, 0) >= {limit} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(strict_hits, 0) AS INTEGER) AS strict_hits, CAST(coalesce(soft_hits, 0) AS INTEGER) AS soft_hits, CAST(coalesce(soft_weight, 0) AS DOUBLE) AS soft_weight
FROM ruled r LEFT JOIN summed s ON r.k = s.k
"""
