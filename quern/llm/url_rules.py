"""URL filtering by pattern rules that are indexed by their rarest literal token.

A token is a maximal run of ASCII letters and digits of the lower-cased URL. A rule's regular expression is
parsed and opened into its alternatives (branches, optional and repeated parts; ``MOST`` at most). From each come the
tokens that any URL that matches it surely contains: literal runs with a non-token character or an anchor on both sides. A rule is
filed under each alternative's token that is rarest over all URLs. A URL's tokens fetch candidate rules and only those
run their expression. An alternative without a sure token is filed under its longest run of literal characters, which an
automaton over all such runs finds inside tokens and across them; only a rule that has an alternative without any literal runs on every URL.

Defined results
- a null URL matches no rule and isn't blocked; an empty URL is matched like any other; long URLs are matched whole;
- matching ignores ASCII case; ``$`` is the end of the URL;
- a URL is blocked if a ``block`` rule matches and no ``allow`` rule does;
- rows are judged one by one: null or repeated ids keep their rows; an empty table gives an empty one;
- no rules: nothing is blocked. Rules that repeat an id are refused (``ValueError``).
"""

from __future__ import annotations

import itertools
import re
from re import _constants as rc
from re import _parser as rp

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import free_names, importable

#: (id, action, pattern) in the syntax that Python's re, Java and RE2 share.
RULES: list[tuple[int, str, str]] = [
    (1, "block", r"^https?://m\."),
    (2, "block", r"[?&]ref=x(&|#|$)"),
    (3, "allow", r"/en/[0-9]+$"),
    (4, "block", r"^https?://([a-z0-9-]+\.)*example\.net/"),
    (5, "block", r"/(login|signup|cart|checkout)(/|\?|$)"),
    (6, "block", r"[?&](utm_[a-z]+|gclid|fbclid)="),
    (7, "block", r"\.(jpg|png|gif|zip|exe|pdf)(\?|#|$)"),
    (8, "block", r"/(tag|tags|category|author)/"),
    (9, "block", r"[?&]page=([5-9]|[0-9]{2,})"),
    (10, "allow", r"^https?://www\.[a-z0-9]+\.example\.org/"),
    (11, "block", r"[?&]session(id)?=[0-9a-f]+"),
    (12, "block", r"#comments?$"),
    (13, "block", r"(casino|poker|viagra)"),
    (14, "block", r"^https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[/:]"),
    (15, "block", r"/wp-(login|admin)"),
    (16, "block", r"//[^/]*--"),
    (17, "allow", r"/de/[0-9]+#top$"),
    (18, "block", r"/(feed|rss|atom)(\.xml)?(/|$)"),
    (19, "block", r"^https?://ads?\."),
    (20, "block", r"/fr/[0-9]+\?page=2&ref=x$"),
]

_TOKEN = re.compile(r"[a-z0-9]+")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def end_anchored(pattern: str) -> str:
    """``pattern`` with each ``$`` outside classes and escapes as the very end."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(r"\Z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def compiled(pattern: str) -> re.Pattern:
    return re.compile(end_anchored(pattern), re.I | re.A)


#: Alternatives of a rule, and what stands in them beside literal characters: an edge of the URL, one character of no token, anything.
MOST = 256
_EVERYWHERE = {"/", ":", "//", "://", "http://", "https://"}
EDGE, DIVIDER, ANY = "<edge>", "<divider>", "<any>"


def _opened(parsed) -> list[list[str]] | None:
    """Alternatives of a parsed expression as sequences of characters, EDGE, DIVIDER and ANY; None if they are too many."""
    out: list[list[str]] = [[]]
    for op, arg in parsed:
        part: list[list[str]] | None
        if op is rc.LITERAL:
            part = [[chr(arg).lower()]]
        elif op is rc.AT and arg in (rc.AT_BEGINNING, rc.AT_BEGINNING_STRING, rc.AT_END_STRING):
            part = [[EDGE]]
        elif op is rc.IN and all(k is rc.LITERAL for k, _ in arg):
            chars = [chr(v) for _, v in arg]
            part = [[DIVIDER]] if not any(c in _WORD for c in chars) else [[c] for c in sorted({c.lower() for c in chars})] if len(chars) <= 4 else [[ANY]]
        elif op is rc.SUBPATTERN and not arg[1] and not arg[2]:
            part = _opened(arg[3])
        elif op is rc.BRANCH:
            opened = [_opened(x) for x in arg[1]]
            part = None if any(x is None for x in opened) else [y for x in opened for y in x]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, item = arg
            one = _opened(item)
            if one is None:
                part = [[ANY]] if least else [[], [ANY]]
            elif most == 1:
                part = one if least else [[], *one]
            else:  # the first and the last time stand at the edges, anything between
                many = [[*x, ANY, *y] for x in one for y in one]
                part = (one + many) if least == 1 else many if least else [[], *one, *many]
        else:
            part = [[ANY]]
        part = [[ANY]] if part is None else part
        if len(out) * len(part) > MOST:
            return None
        out = [x + y for x, y in itertools.product(out, part)]
    return out


def _word(c: str) -> bool:
    return len(c) == 1 and c in _WORD


def sure(pattern: str) -> list[tuple[list[str], str]] | None:
    """(sure tokens, longest literal run) of each alternative: a URL that matches has, for one of them, all its tokens and the run."""
    opened = _opened(rp.parse(end_anchored(pattern), re.I | re.A))
    if opened is None:
        return None
    out = []
    for seq in opened:
        tokens, i = [], 0
        while i < len(seq):
            j = i
            while j < len(seq) and _word(seq[j]):
                j += 1
            if j > i and i and seq[i - 1] != ANY and j < len(seq) and seq[j] != ANY:
                tokens.append("".join(seq[i:j]))
            i = max(j, i + 1)
        runs = ["".join(g) for lit, g in itertools.groupby(seq, lambda c: len(c) == 1 and c.isascii()) if lit]
        out.append((tokens, max(runs, key=lambda r: (r not in _EVERYWHERE, len(r)), default="")))
    return out


class Index:
    """Rules by token, by literal run, and those that run always."""

    def __init__(self, rules: list[tuple[int, str, str]], count: dict[str, int]):
        self.rules = [(i, a, compiled(p)) for i, a, p in rules]
        self.by_token: dict[str, list[int]] = {}
        self.by_run: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, (_, _, p) in enumerate(rules):
            alternatives = sure(p)
            if alternatives is None or any(not t and not r for t, r in alternatives):
                self.always.append(k)
                continue
            for tokens, run in alternatives:
                where, key = (self.by_token, min(tokens, key=lambda t: (count.get(t, 0), t))) if tokens else (self.by_run, run)
                if k not in where.setdefault(key, []):
                    where[key].append(k)
        self.runs = ahocorasick.Automaton()
        for r, ks in self.by_run.items():
            self.runs.add_word(r, ks)
        if self.by_run:
            self.runs.make_automaton()

    def candidates(self, url: str) -> set[int]:
        found, low = set(self.always), url.lower()
        for t in _TOKEN.findall(low):
            if t in self.by_token:
                found.update(self.by_token[t])
        if self.by_run:
            for _, ks in self.runs.iter(low):
                found.update(ks)
        return found

    def match(self, url: str) -> tuple[list[int], bool]:
        """(ids of the rules that match, whether the URL is blocked)"""
        hit = [self.rules[k] for k in self.candidates(url) if self.rules[k][2].search(url)]
        return sorted(i for i, _, _ in hit), any(a == "block" for _, a, _ in hit) and not any(a == "allow" for _, a, _ in hit)


def token_counts(urls: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """How many URLs have each of ``tokens``: one pass over all URLs; only the rules' own tokens reach the driver."""

    def run(batches):
        seen: dict[str, int] = {}
        for b in batches:
            for u in b.column(0).to_pylist():
                for t in set(_TOKEN.findall(u.lower())) & tokens:
                    seen[t] = seen.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])

    rows = urls.select(F.col(f"`{url_col}`").cast("string").alias("u")).where("u is not null").mapInArrow(run, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
    return {r["t"]: r["n"] for r in rows.collect()}


def filter_urls(urls: DataFrame, url_col: str = "url", rules: list[tuple[int, str, str]] = RULES, blocked_col: str = "blocked", rules_col: str = "rules") -> DataFrame:
    """``urls`` with the ids of matching rules (joined by commas, ascending) and whether each URL is blocked.

    The two columns get underscores in front where ``urls`` already has their names.
    """
    if len({i for i, _, _ in rules}) < len(rules) or any(a not in ("block", "allow") for _, a, _ in rules):
        raise ValueError("rules need ids of their own and the action block or allow")
    importable(urls.sparkSession)
    index = Index(rules, token_counts(urls, url_col, {t for *_, p in rules for tokens, _ in sure(p) or [] for t in tokens}))
    blocked_col, rules_col = free_names(urls, blocked_col, rules_col)
    schema = T.StructType([*urls.schema.fields, T.StructField(rules_col, T.StringType()), T.StructField(blocked_col, T.BooleanType())])
    at = urls.columns.index(url_col)

    def run(batches):
        for b in batches:
            got = [index.match(u) if u is not None else ([], False) for u in b.column(at).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([",".join(map(str, r)) for r, _ in got], pa.string()), pa.array([x for _, x in got], pa.bool_())], names=schema.names)

    return urls.mapInArrow(run, schema)


def sql(rules: list[tuple[int, str, str]] = RULES) -> str:
    values = ", ".join(f"({i}, '{a}', '{p}')" for i, a, p in rules)
    return f"""
WITH r(id, action, pattern) AS (VALUES {values}),
m AS (SELECT p.page_id, r.id, r.action FROM pages p JOIN r ON regexp_matches(p.url, r.pattern, 'i')),
g AS (SELECT page_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS rules, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS blocked FROM m GROUP BY page_id)
SELECT p.page_id, coalesce(g.rules, '') AS rules, coalesce(g.blocked, false) AS blocked FROM pages p LEFT JOIN g ON p.page_id = g.page_id
"""
