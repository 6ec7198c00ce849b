"""Encoding of a whole corpus with a public tokenizer, by a table of its distinct words.

The byte-level tokenizer never merges across the words its split pattern gives, so a word's ids don't depend
on its surroundings. Texts are split in Spark by that pattern, each distinct word is encoded once, and the
ids are joined back by word and put in order by position.

A word that makes up a large share of all tokens never becomes a hot join key: short words (of at most ``SHORT``
characters) that make up one token in ``FREQUENT`` or more, of which there can't be more than ``FREQUENT``, are
joined by broadcast where the text is, some MB whatever the corpus; only the rest is shuffled by word.

Defined results: null and empty texts give an empty list; every pair of id and text has one row, repeated rows
count once; a null id is an id; texts of any length are encoded whole; special tokens are never produced, their
strings are ordinary text. The vocabulary file must be at its path on every worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import cut

#: The split pattern of the byte-level tokenizers. (?U) gives \s its Unicode meaning.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FREQUENT, SHORT = 1 << 17, 32


def split(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


@cache
def encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT.removeprefix("(?U)"), mergeable_ranks=table, special_tokens={})


def word_table(docs: DataFrame, text: str, ranks: str = RANKS) -> DataFrame:
    """``(word, n, ids)`` of each distinct word."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(ranks)
        for b in batches:
            yield pd.DataFrame({"word": b.word, "n": b.n, "ids": [e._encode_single_piece(w) for w in b.word]})

    counts = docs.where(F.col(text).isNotNull()).select(F.explode(split(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.mapInPandas(encode, "word string, n long, ids array<int>")


def encode(docs: DataFrame, id_col: str, text: str, ranks: str = RANKS) -> DataFrame:
    """``(id, ids)``: the ids of each text, a list of integers."""
    words = cut(word_table(docs, text, ranks))
    total = words.agg(F.sum("n").alias("total"))
    frequent = words.where(F.length("word") <= SHORT).join(F.broadcast(total), F.col("n") * FREQUENT >= F.col("total")).select("word", "ids")
    placed = docs.select(F.xxhash64(id_col, text).alias("k"), F.col(id_col).alias("id"), F.col(text).alias("text")).repartition("k").dropDuplicates(["k"])
    tokens = placed.where("text IS NOT NULL").select("k", F.posexplode(split("text")).alias("pos", "word"))
    near = tokens.join(F.broadcast(frequent), "word").groupBy("k").agg(F.collect_list(F.struct("pos", "ids")).alias("near"))
    far = tokens.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(words.select("word", "ids"), "word").groupBy("k").agg(F.collect_list(F.struct("pos", "ids")).alias("far"))
    none = F.array().cast("array<struct<pos:int,ids:array<int>>>")
    whole = placed.select("k", "id").join(near, "k", "left").join(far, "k", "left")
    ordered = F.sort_array(F.concat(F.coalesce("near", none), F.coalesce("far", none)))
    return whole.select(F.col("id").alias(id_col), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def decode(encoded: DataFrame, id_col: str, ids: str, ranks: str = RANKS) -> DataFrame:
    """``(id, text)``: the texts, by a join of ids with their pieces. The vocabulary file bounds what is broadcast."""
    e = encoder(ranks)
    vocab = pd.DataFrame({"tok": range(e.n_vocab), "hex": [e.decode_single_token_bytes(t).hex() for t in range(e.n_vocab)]})
    pieces = encoded.sparkSession.createDataFrame(vocab, "tok int, hex string")
    at = encoded.select(F.col(id_col).alias("id"), F.posexplode(ids).alias("pos", "tok")).join(F.broadcast(pieces), "tok")
    text = at.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "hex"))).alias("p")).select(
        "id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), "")), "UTF-8").alias("text"))
    return encoded.select(F.col(id_col).alias("id")).join(text, "id", "left").select(F.col("id").alias(id_col), F.coalesce("text", F.lit("")).alias("text"))
