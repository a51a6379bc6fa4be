"""URL filters: pattern rules found through their rarest literal token.

A rule is a pattern with literal tokens (runs of a-z and 0-9 that stand whole in
every URL it fits). It is filed under the one that is rarest over all URLs; a
rule without a whole token under its longest piece of text. A URL's tokens, and
the pieces found in one pass over it, fetch candidate rules, and only those run
regular expressions. Rules come from a table or a list.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.shared import columns, map_rows, slices

TOKEN = re.compile("[a-z0-9]+")
#: Rules reach every task, so their number is limited by an error, never by a cut.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class SiteRule:
    """Host and path prefix, as in 'example.org/en/'; fits the host and its subdomains."""

    site: str
    verdict: str

    @functools.cached_property
    def regex(self) -> re.Pattern:
        host, _, path = self.site.partition("/")
        return re.compile(rf"(?s)(?:.*\.)?{re.escape(host)}\0{re.escape('/' + path)}")

    def fits(self, host: str, path: str, url: str) -> bool:
        return bool(self.regex.match(f"{host}\0{path}"))

    @property
    def piece(self) -> str:
        return max(self.site.lower().split("/"), key=len)

    @property
    def literals(self) -> list[str]:
        # a token at the end of the prefix may go on in the URL
        return _whole_tokens("." + self.site.lower(), open_end=True)


@dataclass(frozen=True)
class UrlPattern:
    """Text found anywhere in the URL; '*' stands for anything, '^' for a separator or the end."""

    text: str
    verdict: str

    @functools.cached_property
    def regexes(self) -> tuple[re.Pattern, ...]:
        """One for each stretch between stars."""
        separator = {"^": r"(?:[^A-Za-z0-9]|\Z)"}
        return tuple(re.compile("(?s)" + "".join(separator.get(c, re.escape(c)) for c in part)) for part in self.text.split("*") if part)

    def fits(self, host: str, path: str, url: str) -> bool:
        """Stretches one after the other, each at its first place: all have a fixed length, so no other choice ends earlier."""
        at = 0
        for regex in self.regexes:
            found = regex.search(url, at)
            if not found:
                return False
            at = found.end()
        return True

    @property
    def piece(self) -> str:
        return max((p for part in self.text.lower().split("*") for p in part.split("^")), key=len)

    @property
    def literals(self) -> list[str]:
        return [t for piece in self.text.lower().split("*") for t in _whole_tokens(piece.replace("^", "/"), open_end=True)]


def _whole_tokens(text: str, open_end: bool) -> list[str]:
    return [m.group() for m in TOKEN.finditer(text) if m.start() > 0 and not (open_end and m.end() == len(text))]


#: Sites that are judged by contract, and patterns for the others.
SITES = (SiteRule("org/", "allow"), SiteRule("example.org/es/", "block"), SiteRule("example.org/en/1", "block"), SiteRule("com/fr/", "allow"), SiteRule("com/de/", "block"))
PATTERNS = (UrlPattern("?utm_source=feed^", "block"), UrlPattern("/ads/", "block"), UrlPattern("/login^", "block"), UrlPattern("/cart^", "block"), UrlPattern("&sessionid=", "block"))

_UPPER = {c: c + 32 for c in range(65, 91)}
_AFTER = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def host_path(url: str | None) -> tuple[str, str]:
    """Host and path after the first '://'; both empty for a null URL or one without it."""
    found = _AFTER.search(url) if url else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def url_tokens(url: str) -> set[str]:
    return set(TOKEN.findall(url.translate(_UPPER)))


class RuleIndex:
    """Rules by their rarest literal, else by their longest piece; rules without any text are candidates for every URL."""

    def __init__(self, rules: list, counts: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.by_piece: dict[str, list] = defaultdict(list)
        self.always: list = []
        for rule in rules:
            if literals := rule.literals:
                self.by_token[min(literals, key=lambda t: (counts.get(t, 0), t))].append(rule)
            elif rule.piece:
                self.by_piece[rule.piece].append(rule)
            else:
                self.always.append(rule)
        self.pieces = ahocorasick.Automaton()
        for piece in self.by_piece:
            self.pieces.add_word(piece, piece)
        if self.by_piece:
            self.pieces.make_automaton()

    def candidates(self, url: str) -> list:
        found = list(self.always)
        for token in url_tokens(url):
            if token in self.by_token:
                found += self.by_token[token]
        if self.by_piece:
            for piece in {p for _, p in self.pieces.iter(url.lower())}:
                found += self.by_piece[piece]
        return found

    def judge(self, url: str | None, default: str) -> tuple[str, str, str | None, str, int]:
        """host, path, site rule, verdict, number of candidates."""
        host, path = host_path(url)
        url = url or ""
        candidates, site, pattern = self.candidates(url), None, None
        for rule in candidates:
            if isinstance(rule, SiteRule):
                if (site is None or (len(rule.site), rule.site) > (len(site.site), site.site)) and rule.fits(host, path, url):
                    site = rule
            elif (pattern is None or (len(rule.text), rule.text) > (len(pattern.text), pattern.text)) and rule.fits(host, path, url):
                pattern = rule
        verdict = site.verdict if site else pattern.verdict if pattern else default
        return host, path, site.site if site else None, verdict, len(candidates)


def literal_counts(urls: DataFrame, rules: list) -> dict[str, int]:
    """In how many URLs each literal of the rules stands; at most one row per literal returns."""
    wanted = urls.sparkSession.sparkContext.broadcast({t for r in rules for t in r.literals})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches, 4096):
            for url in part["url"].to_pylist():
                if url:
                    seen.update(wanted.value & url_tokens(url))
        yield columns(token=pa.array(list(seen), pa.string()), n=pa.array(list(seen.values()), pa.int64()))

    rows = urls.select("url").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in rows.collect()}


def read_rules(table: DataFrame) -> tuple[tuple[SiteRule, ...], tuple[UrlPattern, ...]]:
    """Site rules and patterns of a table (kind: site or pattern, text, verdict); at most MAX_RULES rows.

    Rows with a null or empty text or a null verdict say nothing and are left
    out; of equal texts of a kind the smallest verdict counts. Another kind is
    an error.
    """
    clean = table.select("kind", "text", "verdict").where("text <> '' and verdict is not null")
    rows = clean.groupBy("kind", "text").agg(F.min("verdict").alias("verdict")).orderBy("kind", "text").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules; they cannot be sent to every task")
    if odd := {r["kind"] for r in rows} - {"site", "pattern"}:
        raise ValueError(f"unknown kind of rule: {sorted(map(str, odd))}")
    of = lambda kind, make: tuple(make(r["text"], r["verdict"]) for r in rows if r["kind"] == kind)
    return of("site", SiteRule), of("pattern", UrlPattern)


def judge_urls(pages: DataFrame, sites: tuple = SITES, patterns: tuple = PATTERNS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, n_candidates of every URL.

    Of the fitting site rules the longest wins (equal lengths: the later text).
    Without one, rule is null and the longest fitting pattern, else the default,
    decides. Null and empty URLs have an empty host and path and get the
    default. Repeated rows and rows without page_id give one row each; other
    columns are ignored; an empty table gives no rows.
    """
    rules = [*sites, *patterns]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be sent to every task")
    index = pages.sparkSession.sparkContext.broadcast((rules, literal_counts(pages, rules)))
    made: list[RuleIndex] = []

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(RuleIndex(*index.value))
        host, path, rule, verdict, n = zip(*(made[0].judge(u, default) for u in batch["url"].to_pylist()), strict=True)
        text = lambda values: pa.array(values, pa.string())
        return columns(page_id=batch["page_id"], host=text(host), path=text(path), rule=text(rule), verdict=text(verdict), n_candidates=pa.array(n, pa.int64()))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return map_rows(rows, part, "page_id long, host string, path string, rule string, verdict string, n_candidates long", rows=4096)
