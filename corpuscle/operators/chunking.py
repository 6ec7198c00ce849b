"""Cutting texts into windows of words, and of whole sentences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.errors import ChunkingError


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ChunkingError("a window needs at least one word")
    if not 0 <= overlap < size:
        raise ChunkingError("the overlap must be smaller than the window")


def windows(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, each sharing ``overlap`` with the one before, until one reaches the end."""
    check(size, overlap)
    step, n = size - overlap, F.size(words)
    k = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def chunk(docs: DataFrame, id_col: str, text: str, size: int = 512, overlap: int = 128) -> DataFrame:
    """``(document_id, chunk_index, total_chunks, tokens, content, id)``: the windows of each text; blank texts have none."""
    # The words are a column of their own: within the windows' lambda they would be split anew for each window.
    words = docs.select(F.col(id_col).alias("document_id"), T.words(text).alias("words"))
    w = words.select("document_id", F.size("words").alias("n"), windows(F.col("words"), size, overlap).alias("w"))
    c = w.select("document_id", "n", F.size("w").alias("total_chunks"), F.posexplode("w").alias("chunk_index", "content"))
    tokens = F.least(F.lit(size), F.col("n") - F.col("chunk_index") * (size - overlap))
    return c.select("document_id", "chunk_index", "total_chunks", tokens.alias("tokens"), "content", F.sha2(F.concat_ws("#", F.col("document_id").cast("string"), "chunk_index"), 256).alias("id"))


def chunk_sections(sections: DataFrame, key: list[str], text: str, size: int = 512, overlap: int = 128) -> DataFrame:
    """``(key.., chunk_index, total_chunks, tokens, content, id)``: windows that never go over the end of a section."""
    w = sections.select(*key, T.words(text).alias("words")).select(*key, windows(F.col("words"), size, overlap).alias("w"))
    c = w.select(*key, F.size("w").alias("total_chunks"), F.posexplode("w").alias("chunk_index", "content"))
    return c.select(*key, "chunk_index", "total_chunks", T.word_count("content").alias("tokens"), "content", F.sha2(F.concat_ws("#", *[F.col(k).cast("string") for k in key], F.col("chunk_index").cast("string")), 256).alias("id"))


def commit_windows(text: str | Column, size: int, overlap: int) -> Column:
    """Windows by model tokens: they go on past the first that reaches the end, but a small rest is left out."""
    size_w, over = T.words_for(size), T.words_for(overlap)
    step = max(size_w - over, 1)
    w = T.words(text)
    n = F.size(w)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s < n) & ((s == 0) | (n - s >= step // 2)))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size_w), " "))


def pack_sentences(docs: DataFrame, id_col: str, text: str, size: int, overlap: int) -> DataFrame:
    """``(document_id, chunk_index, content)``: whole sentences packed up to ``size`` words; longer ones are windowed.

    A new chunk starts with the last ``overlap // 2`` words of the one before. Packing depends on each chunk's
    own content, so it runs row by row in Arrow batches.
    """
    check(size, overlap)
    step = size - overlap

    def long(words: list[str]) -> list[str]:
        if len(words) <= size:
            return [" ".join(words)]
        return [" ".join(words[i : i + size]) for i in range(0, len(words) - size + step, step)]

    def pack(t: str) -> list[str]:
        import re

        out: list[str] = []
        cur: list[str] = []
        for s in (x.split() for x in re.split(r"[.!?]", t)):
            if not s:
                continue
            if cur and len(cur) + len(s) > size:
                out.append(" ".join(cur))
                cur = out[-1].split()[-(overlap // 2) :] if overlap // 2 else []
            if len(s) > size:
                if cur:
                    out.append(" ".join(cur))
                out += long(s)
                cur = []
            else:
                cur = cur + s[:-1] + [s[-1] + "."]
        return [*out, " ".join(cur)] if cur else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b.id, b.text) if t for k, c in enumerate(pack(t))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "content"])

    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return d.mapInPandas(run, "document_id string, chunk_index int, content string")


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_count(text: str | Column, tokenizer: str = TOKENIZER) -> Column:
    """Model tokens of a text by a tokenizer file that every worker can read; 0 for null."""

    @F.pandas_udf("int")
    def f(s: pd.Series) -> pd.Series:
        some = s.fillna("").tolist()
        return pd.Series([len(e.ids) for e in _tokenizer(tokenizer).encode_batch_fast(some, add_special_tokens=False)], index=s.index, dtype="int32")

    return f(T.col(text))


def chunk_tokens(docs: DataFrame, id_col: str, text: str, size: int = 512, overlap: int = 128, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """``(document_id, chunk_index, total_chunks, tokens, content, id)``: windows of model tokens, cut from the text by the tokens' places.

    Without a tokenizer windows of words. A window that begins or ends within a character takes the whole of it.
    """
    check(size, overlap)
    if tokenizer is None:
        return chunk(docs, id_col, text, size, overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, e in zip(b.id, b.text, _tokenizer(tokenizer).encode_batch(b.text.tolist(), add_special_tokens=False)):
                n, at, own = len(e.ids), 0, []
                while at < n:
                    end = min(at + size, n)
                    own.append((end - at, t[e.offsets[at][0] : e.offsets[end - 1][1]]))
                    if end == n:
                        break
                    at += size - overlap
                rows += [(i, k, len(own), *x) for k, x in enumerate(own)]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "total_chunks", "tokens", "content"])

    d = docs.where(F.length(text) > 0).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    c = d.mapInPandas(run, "document_id string, chunk_index int, total_chunks int, tokens int, content string")
    return c.withColumn("id", F.sha2(F.concat_ws("#", "document_id", "chunk_index"), 256))
