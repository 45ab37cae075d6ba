"""Tokeniser fertility: how well public vocabularies fit a text, with rejection bands by language.

Per document: characters a token under a byte-level vocabulary and under a piece vocabulary with byte
fallback, the share of byte-fallback pieces in the latter, and the entropy of its tokens. Tokenising
goes by white-space separated words (with a space before each), each distinct word of a batch once.
Bands are the median and the scaled median absolute deviation, over all documents, of a language
(or script, where ``lang_col`` is missing or null) and a class of length (powers of 4 of the number of
tokens, as entropy and spread depend on it). A class of fewer than ``FEWEST`` documents is held against the band of its whole
language instead, but for entropy, which depends on length, and for documents of fewer than ``LONG`` tokens, whose measures are too noisy for a common band. A document beyond ``WIDTH`` deviations in any measure is rejected.

The result names each document and whether it is kept; its measures aside, no text is moved.

Defined results
- null, empty and blank texts have no tokens: null measures, and they are kept (other rules are for them);
- deviations have a floor, so a class of equal texts rejects none of them; a language of fewer than ``FEWEST`` documents rejects none: it is rare, not junk;
- a null id keeps its row; rows that repeat an id are judged one by one; long texts are measured whole;
- an empty table gives an empty result; other columns are not looked at.

Histograms of the measures (1/200 of a unit) are counted, not the documents, so bands of any corpus come from a small table.
"""

from __future__ import annotations

import base64
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import free_names, importable, keep, small_side
from .textbuf import slices

#: A folder that every worker has, or a URI of any file system that Spark knows.
VOCABULARIES, SENT = "/opt/tokenizers", "<sent>"
BYTE_FILE, PIECE_FILE = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDTH, FEWEST, STEP, LONG = 6.0, 30, 200, 64
MEASURES = ("chars_per_token", "chars_per_piece", "byte_share", "entropy")
FLOORS = (0.05, 0.05, 0.01, 0.1)

_open: dict[str, tuple] = {}


def shipped(spark, folder: str) -> str:
    """The folder as workers see it: files of another file system are sent to them."""
    if "://" not in folder or folder.startswith("file://"):
        return folder.removeprefix("file://")
    for name in (BYTE_FILE, PIECE_FILE):
        spark.sparkContext.addFile(f"{folder.rstrip('/')}/{name}")
    return SENT


def vocabularies(folder: str) -> tuple:
    """(byte-level encoding, piece processor, whether a piece is a byte), once a process."""
    if folder == SENT:
        from pyspark import SparkFiles

        folder = SparkFiles.getRootDirectory()
    if folder not in _open:
        import sentencepiece
        import tiktoken

        with open(os.path.join(folder, BYTE_FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECE_FILE))
        is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
        _open[folder] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sp, is_byte)
    return _open[folder]


def entropies(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Bits of each document's token distribution; doc is ascending."""
    out = np.zeros(n)
    if not len(ids):
        return out
    key = np.sort(doc.astype(np.int64) << 32 | ids)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    c = np.diff(np.concatenate([at, [len(key)]])).astype(float)
    d = key[at] >> 32
    total = np.bincount(doc, minlength=n).astype(float)
    p = c / total[d]
    return np.bincount(d, weights=-p * np.log2(p), minlength=n)


def measure(text: pa.Array, folder: str = VOCABULARIES) -> dict[str, np.ndarray]:
    """Measures and number of tokens of each text; those of no token have NaN."""
    enc, sp, is_byte = vocabularies(folder)
    n = len(text)
    words = pc.utf8_split_whitespace(pc.fill_null(text, ""))
    per = np.asarray(pc.list_value_length(words)).astype(np.int64)
    flat = words.flatten()
    doc = np.repeat(np.arange(n), per)
    shown = np.asarray(pc.not_equal(flat, "")) if len(flat) else np.zeros(0, bool)
    flat, doc = flat.filter(pa.array(shown)), doc[shown]
    coded = flat.dictionary_encode()
    at = np.asarray(coded.indices)
    distinct = coded.dictionary.to_pylist()
    chars = np.asarray(pc.utf8_length(coded.dictionary)).astype(np.int64) + 1
    first = list(map(enc.encode_ordinary, map(" ".__add__, distinct)))
    second = sp.encode(distinct, num_threads=1) if distinct else []
    n1, n2 = (np.fromiter(map(len, x), np.int64, len(x)) for x in (first, second))
    pieces = np.fromiter(itertools.chain.from_iterable(second), np.int64, int(n2.sum()))
    b2 = np.add.reduceat(np.append(is_byte[pieces].astype(np.int64), 0), np.concatenate([[0], np.cumsum(n2)])[:-1]) if len(n2) else n2
    b2 = np.where(n2 > 0, b2, 0)
    total = lambda x: np.bincount(doc, weights=x[at], minlength=n) if len(at) else np.zeros(n)
    tokens, pieces_n, length = total(n1), total(n2), total(chars)
    # token ids of all words, word after word
    ids = np.fromiter(itertools.chain.from_iterable(first), np.int64, int(n1.sum()))
    start = np.concatenate([[0], np.cumsum(n1)])[:-1] if len(n1) else n1
    count = n1[at]
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    h = entropies(ids[np.repeat(start[at], count) + place], np.repeat(doc, count), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = {"chars_per_token": length / tokens, "chars_per_piece": length / pieces_n, "byte_share": total(b2) / pieces_n, "entropy": np.where(tokens > 0, h, np.nan)}
    return {"n_tokens": tokens.astype(np.int64), **out}


def _script(c):
    """Script of most letters, for documents without a language."""
    count = lambda p: F.length(F.regexp_replace(c, f"[^{p}]", ""))
    names = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "han": r"\p{IsHan}", "arabic": r"\p{IsArabic}", "greek": r"\p{IsGreek}", "devanagari": r"\p{IsDevanagari}", "kana": r"\p{IsHiragana}\p{IsKatakana}", "hangul": r"\p{IsHangul}"}
    best = F.array_max(F.array(*[F.struct(count(p).alias("n"), F.lit(s).alias("s")) for s, p in names.items()]))
    return F.when(best["n"] > 0, F.concat(F.lit("script "), best["s"])).otherwise(F.lit("script none"))


def measured(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", folder: str = VOCABULARIES) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the measures, the number of tokens and the band's group, and those columns' names."""
    importable(docs.sparkSession)
    folder = shipped(docs.sparkSession, folder)
    wanted = (*MEASURES, "n_tokens", "band")
    names = dict(zip(wanted, free_names(docs, *wanted)))
    text = F.col(f"`{text_col}`")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), _script(text)) if lang_col in docs.columns else _script(text)
    marked = docs.withColumn(names["band"], lang)
    added = [*(T.StructField(names[m], T.DoubleType()) for m in MEASURES), T.StructField(names["n_tokens"], T.LongType())]
    schema = T.StructType([*marked.schema.fields, *added])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[at], 8 << 20):
                got = measure(part.column(at), folder)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[m], from_pandas=True) for m in MEASURES), pa.array(got["n_tokens"])], names=schema.names)

    out = marked.mapInArrow(run, schema)
    n = F.col(names["n_tokens"])
    return out.withColumn(names["band"], F.when(n > 0, F.concat_ws(" ", names["band"], F.floor(F.log(n.cast("double")) / F.log(F.lit(4.0))).cast("string")))), names


def bands(rows: DataFrame, names: dict[str, str], fewest: int = FEWEST) -> DataFrame:
    """(band, measure number, median, deviation) from histograms over all documents."""
    w = Window.partitionBy("band", "m").orderBy("v")

    def median(x: DataFrame) -> DataFrame:
        c = x.groupBy("band", "m", "v").agg(F.sum("n").alias("n")).withColumn("cum", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("band", "m")))
        return c.where((F.col("cum") * 2 >= F.col("all")) & ((F.col("cum") - F.col("n")) * 2 < F.col("all"))).select("band", "m", F.col("v").alias("mid"), "all")

    values = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.round(F.col(names[m]) * STEP).cast("long").alias("v")) for i, m in enumerate(MEASURES)])).alias("x")
    hist = keep(rows.where(F.col(names["band"]).isNotNull()).select(F.col(names["band"]).alias("band"), values).select("band", "x.m", "x.v").where("v is not null").groupBy("band", "m", "v").agg(F.count(F.lit(1)).alias("n")), "fertility-hist")
    mid = median(hist)
    off = hist.join(mid, ["band", "m"]).select("band", "m", F.abs(F.col("v") - F.col("mid")).alias("v"), "n")
    dev = median(off).select("band", "m", F.col("mid").alias("mad"))
    return mid.join(dev, ["band", "m"]).where(F.col("all") >= fewest).select("band", "m", (F.col("mid") / STEP).alias("mid"), (F.col("mad") * 1.4826 / STEP).alias("dev"))


def fertility(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, n_tokens, measures, band, kept) of each document."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *([F.col("lang")] if "lang" in docs.columns else []))
    rows, names = measured(slim, "text", "lang" if "lang" in docs.columns else None, how.get("folder", VOCABULARIES))
    # only the measures are kept and joined; texts stay where they were read
    rows = keep(rows.select("doc_id", *[F.col(names[x]).alias(x) for x in ("n_tokens", *MEASURES, "band")]), "fertility")
    plain = {x: x for x in (*MEASURES, "n_tokens", "band")}
    table = bands(rows, plain, how.get("fewest", FEWEST))
    wide = keep(table.groupBy("band").pivot("m", list(range(len(MEASURES)))).agg(F.first("mid").alias("mid"), F.first("dev").alias("dev")).withColumnRenamed("band", "b_"), "fertility-bands")
    # classes of few documents: the band of the language
    language = F.regexp_replace("band", " -?[0-9]+$", "")
    by_language = bands(rows.withColumn("band", language), plain, how.get("fewest", FEWEST))
    whole = keep(by_language.groupBy("band").pivot("m", list(range(len(MEASURES)))).agg(F.first("mid").alias("lmid"), F.first("dev").alias("ldev")).withColumnRenamed("band", "l_"), "fertility-languages")
    out = rows.join(small_side(wide, 128), F.col("band") == F.col("b_"), "left").join(small_side(whole, 128), language == F.col("l_"), "left")
    bad = F.lit(False)
    for i, m in enumerate(MEASURES):
        own = m == "entropy"
        mid, dev = (F.col(f"{i}_{x}") if own else F.coalesce(F.col(f"{i}_{x}"), F.when(F.col("n_tokens") >= how.get("long", LONG), F.col(f"{i}_l{x}"))) for x in ("mid", "dev"))
        bad = bad | F.coalesce(F.abs(F.col(m) - mid) > how.get("width", WIDTH) * F.greatest(dev, F.lit(FLOORS[i])), F.lit(False))
    return out.select("doc_id", "n_tokens", *MEASURES, "band", (~bad).alias("kept"))
