"""Free-entered names to a canonical list, by a prefix-filter set-similarity join.

A name becomes a set of tokens: the letters of its words with their count (typing
errors keep most of them), and whole tokens for what must not be blurred (numbers,
focal ranges, apertures, marks, feature codes).  Spellings with the same parts are one
name.  Tokens are ordered by global rarity; only the rarest tokens of either side, as
many as the threshold requires, are joined; length and position filters drop pairs
that can't reach it; Jaccard similarity is then computed exactly.  The pairs that pass
are checked exactly on what tells two products of one maker apart (numbers, mark,
features), their words may differ by typing errors only, and the most similar entry is
kept; a value whose best is not unique means none.

No words are given: feature codes and the words for a product's generation are read
off the list, and what people and tools add to names (company forms, remarks) are the
words written beside many different makers.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import salted_join
from ..session import cut, merge_join

THRESHOLD = 0.5
BESIDE = 5  # a word beside every fifth maker, and at least three, says nothing about the product
SMALL_LIST = 50_000  # rows of the list's prefixes up to which they go to every task
# Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ø": "o", "ł": "l", "đ": "d", "ı": "i",
})
DASHES = str.maketrans({c: "-" for c in "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"})
# Roman numbers of a product's generation.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5}


def clean(text: str) -> str:
    """Lower case, Latin look-alikes, no accents, no control characters, single blanks."""
    t = unicodedata.normalize("NFKD", text.lower().translate(LOOKALIKES).translate(DASHES))
    t = "".join(c for c in t if not unicodedata.combining(c)).lower().translate(LOOKALIKES).translate(DASHES)
    t = re.sub(r"[\x00-\x1f\x7f\u200b-\u200f\ufeff]", " ", t)
    return re.sub(r"\s+", " ", t).strip().strip("\"'`").strip()


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, or ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def allowed(word: str) -> int:
    """Typing errors a word of this length may have."""
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


_GENERATION = re.compile(r"(?:\b|(?<=[\d_]))([a-z]+?)[ ._-]*(\d|i{1,3}|iv|v)(?![a-z0-9])")
_LISTED_GENERATION = re.compile(r"([a-z]{2,}) (?:i{1,3}|iv|v)$")
_ROMAN_END = re.compile(r"(?<=[\s_\-\d])(i{2,3}|iv)\s*$")
_FOCAL = re.compile(r"(?<![\d.])(\d{1,4}(?:\.\d+)?(?:-\d{1,4}(?:\.\d+)?)?)\s*mm\b")
_APERTURE = re.compile(r"(?:\bf ?/? ?|\b1 ?: ?)(\d{1,2}(?:[.,]\d+)?(?:-\d{1,2}(?:[.,]\d+)?)?)")
_NUMBERS = re.compile(r"(?<![\d.,])(\d{1,4}(?:-\d{1,4})?)(?:mm)?\s*[/ ]\s*(\d{1,2}(?:[.,]\d+)?(?:-\d{1,2}(?:[.,]\d+)?)?)(?![\d])")


@dataclass(frozen=True)
class Vocabulary:
    """Words that names are read by: feature codes, words for a generation, words that mean no product."""

    features: frozenset[str] = field(default_factory=frozenset)
    generation: frozenset[str] = field(default_factory=frozenset)
    fillers: frozenset[str] = field(default_factory=frozenset)

    def is_generation(self, word: str) -> bool:
        """Whether a word is one for a generation, with a typing error or shortened (its first letter and some others in order)."""
        for g in self.generation:
            rest = iter(g)
            if word[0] == g[0] and all(c in rest for c in word) or distance(word, g, 1) <= 1:
                return True
        return False

    def without_fillers(self, words: list[str]) -> list[str]:
        return [w for w in words if w not in self.fillers]


class Name:
    """A name in parts: words, exact tokens (numbers, marks), feature codes."""

    __slots__ = ("words", "exact", "features")

    def __init__(self, words: list[str], exact: list[str], features: list[str]) -> None:
        self.words, self.exact, self.features = words, exact, features

    def key(self) -> str:
        return json.dumps([self.words, sorted(self.exact), self.features])

    def tokens(self) -> list[str]:
        count: dict[str, int] = {}
        out = set(self.exact) | {f"+{f}" for f in self.features}
        for c in "".join(self.words):
            count[c] = count.get(c, 0) + 1
            out.add(f"{c}{count[c]}")
        return sorted(out)


def parse(kind: str, text: str, voc: Vocabulary) -> Name:
    """The parts of a written make, model or lens."""
    t = clean(text)
    if kind == "make":
        kept = voc.without_fillers(re.findall(r"[a-z]+", t))
        return Name(kept, [f"#{n}" for n in re.findall(r"\d+", t)] if kept else [], [])
    if kind == "model":
        t = re.sub(r"#\s*\d+\b|\*", " ", t).strip()
        mark = None
        for m in _GENERATION.finditer(t):
            if m.start() > 0 and voc.is_generation(m[1]):
                mark, t = m[2], t[: m.start()] + " " + t[m.end() :]
                break
        t = re.sub(r"\([^)]*\)?|[()]", " ", t).strip()
        t = re.sub(r"\s+-\s+[a-z ]+$", " ", t).strip()
        if mark is None and (m := _ROMAN_END.search(t)):
            mark, t = m[1], t[: m.start()]
        exact = [] if mark is None else [f"@{ROMAN.get(mark, mark)}"]
        numbers = re.findall(r"(\d+)(s(?![a-z]))?", t)
        exact += [f"#{n}{s}" for n, s in numbers]
        words = re.findall(r"[a-z]+", re.sub(r"(\d+)s(?![a-z])", r"\1 ", t))
        return Name(voc.without_fillers(words), exact, [])
    t = re.sub(r"\([^)]*\)?|[()*]", " ", t)
    t = re.sub(r"(?<=\d),(?=\d)", ".", t)
    exact, focal, aperture = [], None, None
    m = _APERTURE.search(t)
    if m:
        aperture, t = m[1], t[: m.start()] + " " + t[m.end() :]
        f = _FOCAL.search(t) or re.search(r"(?<![\d.])(\d{1,4}(?:-\d{1,4})?)(?![\d.])", t)
        if f:
            focal, t = f[1], t[: f.start()] + " " + t[f.end() :]
    elif m := _NUMBERS.search(t):
        focal, aperture, t = m[1], m[2], t[: m.start()] + " " + t[m.end() :]
    elif m := _FOCAL.search(t):
        focal, t = m[1], t[: m.start()] + " " + t[m.end() :]
    tidy = lambda x: "-".join(f"{float(v):g}" for v in x.split("-"))
    if focal:
        exact.append(f"f{tidy(focal)}")
    if aperture:
        exact.append(f"a{tidy(aperture)}")
    exact += [f"#{n}" for n in re.findall(r"\d+(?:\.\d+)?", t)]
    words = voc.without_fillers([w for w in re.findall(r"[a-z]+", t) if w not in ("mm", "f")])
    return Name([w for w in words if w not in voc.features], exact, sorted({w for w in words if w in voc.features}))


def _same_words(written: list[str], meant: list[str]) -> int | None:
    """Typing errors between two lists of words, None if they are other words."""
    if len(written) != len(meant):
        one, two = "".join(written), "".join(meant)  # words run together or torn apart
        return 0 if one == two and one else None
    total = 0
    for a, b in zip(written, meant):
        d = distance(a, b, allowed(b))
        if d > allowed(b):
            return None
        total += d
    return total


def _is_maker(written: list[str], maker: list[str]) -> int | None:
    """Typing errors in a maker's name, None if it is another; an exact name may have more words behind it."""
    edits = _same_words(written, maker)
    return 0 if edits is None and maker and written[: len(maker)] == maker else edits


def check(kind: str, value: Name, maker: Name, own: Name) -> tuple[int, int] | None:
    """``(tier, edits)`` if the value can mean the entry, else None.

    ``own`` is the entry's name without its maker.  Tiers: 0 its maker is written,
    1 it isn't; 3 more for a lens of which features are left out.  A feature the
    entry hasn't makes it another lens.
    """
    if kind == "make":
        edits = _is_maker(value.words, maker.words) if not value.exact else None
        return None if edits is None else (0, edits)
    if sorted(value.exact) != sorted(own.exact):
        return None
    tier = 0
    if kind == "lens":
        if not set(value.features) <= set(own.features):
            return None
        tier = 0 if len(value.features) == len(own.features) else 3
    n = len(own.words)
    for words in (value.words, value.words[n:] + value.words[:n]) if n and kind == "model" else (value.words,):
        head, tail = (words[:-n], words[-n:]) if n else (words, [])
        edits = _same_words(tail, own.words) if n else 0
        if edits is None:
            continue
        if not head:
            return tier + 1, edits
        more = _is_maker(head, maker.words)
        if more is not None:
            return tier, edits + more
    return None


def _entries(refs: DataFrame) -> DataFrame:
    """``kind, ref_id, maker, own`` of every name of every entry (canonical and market names)."""
    ok = refs.where("ref_kind in ('make', 'model', 'lens') and canonical_name is not null and ref_id is not null")
    own = F.when(F.startswith("canonical_name", F.concat("maker", F.lit(" "))), F.expr("substring(canonical_name, length(maker) + 2)")).otherwise(F.col("canonical_name"))
    canonical = ok.select(F.col("ref_kind").alias("kind"), "ref_id", F.coalesce("maker", "canonical_name").alias("maker"), F.when(F.col("ref_kind") == "make", F.lit("")).otherwise(own).alias("own"))
    market = ok.where("other_name is not null and ref_kind != 'make'").select(F.col("ref_kind").alias("kind"), "ref_id", F.col("maker"), F.col("other_name").alias("own"))
    return canonical.unionByName(market).distinct()


def _listed_words(refs: DataFrame) -> tuple[Vocabulary, set[str], dict[str, str]]:
    """The list's own vocabulary, all of its words, and the makers by the first word of their names."""
    rows = _entries(refs).select("kind", "maker", "own").collect()  # the list
    maker_words = {w for r in rows for w in re.findall(r"[a-z]+", clean(r["maker"] or ""))}
    words = {k: [w for r in rows if r["kind"] == k for w in re.findall(r"[a-z]+", clean(r["own"]))] for k in ("model", "lens")}
    generation = {m[1] for r in rows if r["kind"] == "model" and (m := _LISTED_GENERATION.search(clean(r["own"])))}
    features = {w for w in words["lens"] if w not in maker_words and w not in ("mm", "f")}
    makers = {m[0]: r["maker"] for r in rows if r["maker"] and (m := re.findall(r"[a-z]+", clean(r["maker"])))}
    return Vocabulary(frozenset(features), frozenset(generation)), maker_words | set(words["model"]) | set(words["lens"]), makers


def vocabulary(values: DataFrame, refs: DataFrame) -> Vocabulary:
    """The list's vocabulary and the words that the written ``values`` (``kind, value``, distinct) have beside many makers."""
    voc, listed, makers = _listed_words(refs)

    @F.pandas_udf("array<struct<word: string, maker: string>>")
    def beside(kind: pd.Series, value: pd.Series) -> pd.Series:
        out = []
        for v in value:
            words = re.findall(r"[a-z]+", clean(v))
            seen = [makers[w] for w in words if w in makers]
            out.append([{"word": w, "maker": seen[0]} for w in sorted(set(words)) if w not in listed] if seen else [])
        return pd.Series(out, dtype=object)

    least = max(3, -(-len(set(makers.values())) // BESIDE))
    met = values.select(F.explode(beside.asNondeterministic()("kind", "value")).alias("b")).groupBy("b.word").agg(F.countDistinct("b.maker").alias("n"))
    # Only words common to a fifth of all makers come to the driver.
    common = [r["word"] for r in met.where(F.col("n") >= least).select("word").collect()]
    typed = lambda w: any(distance(w, x, allowed(x)) <= allowed(x) for x in listed) or voc.is_generation(w)
    return Vocabulary(voc.features, voc.generation, frozenset(w for w in common if not typed(w)))


def _bounded(df: DataFrame, most: int = SMALL_LIST) -> DataFrame:
    """The hint by which to join a table made from the list: to every task if its rows are counted and few, else by sorting."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``kind, l, r, jaccard`` of all pairs of one kind with Jaccard similarity of at least ``threshold``.

    ``left``: ``kind, l, tokens``; ``right``: ``kind, r, tokens``, the reference
    side.  Tokens the right side hasn't are rarer than all others: they fill the
    front of a prefix and are joined with nothing.
    """
    lt = left.select("kind", "l", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rt = right.select("kind", "r", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    shared = rt.select("kind", "token").distinct()
    seen = lt.join(_bounded(shared), ["kind", "token"], "left_semi").select("kind", "token").unionByName(rt.select("kind", "token"))
    # One row for each token of the reference list.
    rank = cut(seen.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("c")).withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy("c", "token"))).drop("c"))

    def ranked(rows: DataFrame, side: str) -> DataFrame:
        return rows.join(_bounded(rank), ["kind", "token"]).groupBy("kind", side, "n").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))

    lr, rr = cut(ranked(lt, "l")), cut(ranked(rt, "r"))
    keep = lambda n: n - F.ceil(F.lit(threshold) * n - 1e-9) + 1
    unknown = F.col("n") - F.size("ranks")
    lp = lr.select("kind", "l", F.col("n").alias("ln"), unknown.alias("skip"), F.posexplode(F.slice("ranks", F.lit(1), F.greatest(F.lit(0), keep(F.col("n")) - unknown).cast("int"))).alias("i", "rank"))
    rp = rr.select("kind", "r", F.col("n").alias("rn"), F.posexplode(F.slice("ranks", F.lit(1), keep(F.col("n")).cast("int"))).alias("j", "rank"))
    fits = (F.col("rn") >= threshold * F.col("ln") - 1e-9) & (F.col("ln") >= threshold * F.col("rn") - 1e-9)
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("ln") + F.col("rn")) - 1e-9)
    # The first common token: everything before it is lost, at most the rest is common.
    first = F.least(F.col("ln") - F.col("skip") - F.col("i"), F.col("rn") - F.col("j"))
    # The left side's hot tokens stay where they are as long as the list is short.
    met = lp.join(_bounded(rp), ["kind", "rank"]).where(fits).groupBy("kind", "l", "r", "ln", "rn").agg(F.max(first).alias("most")).where(F.col("most") >= need)
    common = F.size(F.array_intersect("ranks", "r_ranks"))
    both = merge_join(met, lr.select("kind", "l", "ranks"), ["kind", "l"]).join(_bounded(rr.select("kind", "r", F.col("ranks").alias("r_ranks"))), ["kind", "r"])
    exact = both.withColumn("jaccard", common / (F.col("ln") + F.col("rn") - common))
    return exact.where(F.col("jaccard") >= threshold).select("kind", "l", "r", "jaccard")


def match_names(names: DataFrame, refs: DataFrame, voc: Vocabulary, threshold: float = THRESHOLD) -> DataFrame:
    """``kind, name, ref_id, maker, tier, edits, jaccard`` of all entries that a name (``kind, name, tokens``, distinct) can mean."""

    @F.pandas_udf("struct<name: string, tokens: array<string>>")
    def entry(kind: pd.Series, maker: pd.Series, own: pd.Series, form: pd.Series) -> pd.DataFrame:
        out = []
        for k, m, o, f in zip(kind, maker, own, form):
            n, q = parse("make", m, voc), parse(k, o, voc) if o else Name([], [], [])
            out.append((q.key(), Name([*(n.words if f else []), *q.words], q.exact, q.features).tokens()))
        return pd.DataFrame(out, columns=["name", "tokens"])

    @F.pandas_udf("struct<tier: int, edits: int>")
    def verify(kind: pd.Series, name: pd.Series, maker: pd.Series, own: pd.Series) -> pd.DataFrame:
        opened: dict[str, Name] = {}

        def part(x: str) -> Name:
            if x not in opened:
                opened[x] = Name(*json.loads(x))
            return opened[x]

        got = [check(k, part(n), parse("make", m, voc), part(o)) or (None, None) for k, n, m, o in zip(kind, name, maker, own)]
        return pd.DataFrame(got, columns=["tier", "edits"]).astype("Int32")

    forms = F.explode(F.array(F.lit(True), F.lit(False))).alias("form")
    # Not deterministic: else filters on the results would be pushed below and run the functions again.
    entries = _entries(refs).select("*", forms).where("form or kind != 'make'").withColumn("e", entry.asNondeterministic()("kind", "maker", "own", "form"))
    entries = cut(entries.select("kind", "ref_id", "maker", "form", F.col("e.name").alias("own"), F.col("e.tokens").alias("tokens")).where(F.size("tokens") > 0).withColumn("r", F.monotonically_increasing_id()))
    left = cut(names.where(F.size("tokens") > 0).withColumn("l", F.monotonically_increasing_id()))
    pairs = similar_pairs(left.select("kind", "l", "tokens"), entries.select("kind", "r", "tokens"), threshold)
    rows = merge_join(pairs, left.select("l", "name"), "l").join(_bounded(entries.select("r", "ref_id", "maker", "own")), "r")
    return rows.withColumn("v", verify.asNondeterministic()("kind", "name", "maker", "own")).where("v.tier is not null").select("kind", "name", "ref_id", "maker", "v.tier", "v.edits", F.round("jaccard", 9).alias("jaccard"))


def best_of(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ref_id``: the best entry of each key, -1 where it isn't one alone.

    ``candidates``: ``keys, ref_id, tier, edits, jaccard``.  The lower tier comes
    first, then the more similar entry, then fewer typing errors; of lenses with
    features left out (tiers from 3) none is better than another.
    """
    left_out = F.col("tier") >= 3
    how = F.struct("tier", F.when(left_out, 0.0).otherwise(-F.col("jaccard")).alias("far"), F.when(left_out, 0).otherwise(F.col("edits")).alias("edits")).alias("how")
    one = candidates.groupBy(*keys, "ref_id").agg(F.min(how).alias("how"))
    # Entries are few for a key: each has been verified.
    ranked = one.withColumn("place", F.rank().over(W.partitionBy(*keys).orderBy("how"))).where(F.col("place") == 1)
    return ranked.groupBy(*keys).agg(F.min("ref_id").alias("ref_id"), F.count(F.lit(1)).alias("n")).select(*keys, F.when(F.col("n") == 1, F.col("ref_id")).otherwise(F.lit(-1)).cast("bigint").alias("ref_id"))


FIELDS = {"camera_make": "make", "camera_model": "model", "lens_model": "lens"}


def match_metadata(metadata: DataFrame, refs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``metadata_id, field_name, value, ref_id`` of every written value that isn't itself a canonical name.

    Null and blank values have no row; a row repeated whole counts once, and of
    rows with one id but different content the smallest values count.
    """
    once = metadata.where("metadata_id is not null").groupBy("metadata_id").agg(F.min(F.struct(*FIELDS)).alias("m")).select("metadata_id", "m.*")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(k).alias("kind"), F.col(f).alias("value")) for f, k in FIELDS.items()])).alias("f")
    written = cut(once.select("metadata_id", F.col("camera_make").alias("make"), fields).select("metadata_id", "make", "f.*").where(F.col("value").rlike(r"(?U)[^\s]")))
    known = refs.where("canonical_name is not null and ref_id is not null")
    canonical = known.select(F.col("ref_kind").alias("kind"), F.col("canonical_name").alias("value")).distinct()
    rows = written.join(_bounded(canonical), ["kind", "value"], "left_anti")
    combos = cut(rows.groupBy("kind", "value", "make").agg(F.count(F.lit(1)).alias("n")))
    makes = combos.where("make is not null").select(F.lit("make").alias("kind"), F.col("make").alias("value"))
    values = cut(combos.select("kind", "value").unionByName(makes).distinct())
    voc = vocabulary(values, refs)

    @F.pandas_udf("struct<name: string, tokens: array<string>>")
    def read(kind: pd.Series, value: pd.Series) -> pd.DataFrame:
        got = [parse(k, v, voc) for k, v in zip(kind, value)]
        return pd.DataFrame([(g.key(), g.tokens()) for g in got], columns=["name", "tokens"])

    named = cut(values.withColumn("p", read.asNondeterministic()("kind", "value")).select("kind", "value", F.col("p.name").alias("name"), F.col("p.tokens").alias("tokens")))
    # A name says all of its tokens.
    names = named.groupBy("kind", "name").agg(F.first("tokens").alias("tokens"))
    can = cut(match_names(names, refs, voc, threshold))
    of_name = best_of(can.where("kind = 'make'"), ["name"])
    makers = known.where("ref_kind = 'make'").select("ref_id", F.col("canonical_name").alias("row_maker"))
    of_make = cut(merge_join(named.where("kind = 'make'").select("value", "name"), of_name, "name", "left").select("value", F.coalesce("ref_id", F.lit(-1)).cast("bigint").alias("ref_id")))
    maker_of = of_make.join(_bounded(makers), "ref_id").select(F.col("value").alias("make"), "row_maker")
    # A name, the maker that its rows name, and what they can mean together.
    others = merge_join(combos.where("kind != 'make'"), maker_of, "make", "left").withColumn("row_maker", F.coalesce("row_maker", F.lit("")))
    placed = cut(merge_join(others.select("kind", "value", "make", "row_maker"), named.select("kind", "value", "name"), ["kind", "value"]))
    pairs = merge_join(placed.select("kind", "name", "row_maker").distinct(), can.where("kind != 'make'"), ["kind", "name"])
    bare = F.when((F.col("tier") % 3 == 1) & (F.col("row_maker") != F.col("maker")), F.col("tier") + 1).otherwise(F.col("tier"))
    meant = best_of(pairs.withColumn("tier", bare), ["kind", "name", "row_maker"])
    blank = F.coalesce("make", F.lit("\x00")).alias("make")
    found = merge_join(placed, meant, ["kind", "name", "row_maker"], "left").select("kind", "value", blank, "ref_id")
    itself = merge_join(combos.where("kind = 'make'").select("kind", "value", blank), of_make, "value").select("kind", "value", "make", "ref_id")
    lookup = cut(found.unionByName(itself).withColumn("ref_id", F.coalesce("ref_id", F.lit(-1)).cast("bigint")))
    keyed = rows.withColumn("make", blank)
    return salted_join(keyed, lookup, ["kind", "value", "make"], "metadata_id", salts=4).select("metadata_id", "field_name", "value", "ref_id")
