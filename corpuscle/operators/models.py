"""Pluggable models: embedders and rerankers as Arrow-batched functions, loaded once per worker."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.text import col


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class MockEmbedder:
    """Deterministic stand-in: the sum of the bytes times the place, in thousandths."""

    dims: int = 8

    def embed(self, texts: list[str]) -> np.ndarray:
        h = np.array([sum(t.encode("utf-8")) for t in texts], "u8")
        return ((h[:, None] * np.arange(1, self.dims + 1, dtype="u8")) % 1000 / 1000).astype("f4")


@dataclass(frozen=True)
class ModelInfo:
    """What is to be known of a model; its files are local, below a folder named like its id."""

    repo_id: str
    dims: int = 0
    max_tokens: int = 512
    model_file: str = "onnx/model.onnx"
    tokenizer_file: str = "tokenizer.json"
    normalize: bool = True

    def capped(self, most: int) -> ModelInfo:
        return replace(self, max_tokens=most) if 0 < most < self.max_tokens else self

    def local(self, root: str, least_bytes: int = 1000) -> tuple[str, str]:
        """Paths of model and tokenizer; files that are missing or too small to be any are an error."""
        found = tuple(os.path.join(root, self.repo_id.replace("/", "--"), f) for f in (self.model_file, self.tokenizer_file))
        for f in found:
            if not os.path.exists(f) or os.path.getsize(f) <= least_bytes:
                raise FileNotFoundError(f"no model file at {f}")
        return found

    def embedder(self, root: str) -> OnnxEmbedder:
        model, tokenizer = self.local(root)
        return OnnxEmbedder(model, tokenizer, self.dims, self.max_tokens)


#: Known models, by short name.
EMBEDDING_MODELS = {
    "default": ModelInfo("jinaai/jina-embeddings-v2-base-code", 768, 8192),
    "bge-small": ModelInfo("BAAI/bge-small-en-v1.5", 384, 512),
    "minilm-l6": ModelInfo("sentence-transformers/all-MiniLM-L6-v2", 384, 256),
    "nemotron-8b": ModelInfo("nvidia/llama-embed-nemotron-8b", 4096, 4096),
}
RERANK_MODELS = {
    "default": ModelInfo("cross-encoder/ms-marco-MiniLM-L-6-v2", 0, 512),
    "rerankqa-mistral-4b": ModelInfo("nvidia/nv-rerankqa-mistral-4b-v3", 0, 2048),
}


def providers() -> list[str]:
    """Execution providers of this machine's runtime, accelerators first; the processor alone without a runtime."""
    try:
        import onnxruntime
    except ImportError:
        return ["CPUExecutionProvider"]
    return onnxruntime.get_available_providers()


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean over the places that count, at length 1."""
    m = mask[..., None].astype(hidden.dtype)
    v = (hidden * m).sum(1) / np.maximum(m.sum(1), 1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n > 0, v / np.where(n > 0, n, 1), v)


@cache
def _session(model: str, tokenizer: str):
    import onnxruntime
    from tokenizers import Tokenizer

    o = onnxruntime.SessionOptions()
    o.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(model, o, providers=providers()), Tokenizer.from_file(tokenizer)


def _inputs(model: str, tokenizer: str, texts: list, most: int) -> tuple:
    s, t = _session(model, tokenizer)
    t.enable_truncation(most)
    t.enable_padding()
    e = t.encode_batch(texts)
    feed = {"input_ids": np.array([x.ids for x in e], "i8"), "attention_mask": np.array([x.attention_mask for x in e], "i8"), "token_type_ids": np.array([x.type_ids for x in e], "i8")}
    names = {i.name for i in s.get_inputs()}
    return s, {k: v for k, v in feed.items() if k in names}, feed["attention_mask"]


@dataclass(frozen=True)
class OnnxEmbedder:
    """A sentence encoder from local files, which every worker must be able to read."""

    model: str
    tokenizer: str
    dims: int = 768
    max_tokens: int = 2048

    def embed(self, texts: list[str]) -> np.ndarray:
        s, feed, mask = _inputs(self.model, self.tokenizer, texts, self.max_tokens)
        return mean_pool(s.run(None, feed)[0], mask).astype("f4")


def embedding(text: str | Column, model: Embedder, batch: int = 32) -> Column:
    """The model's vectors of a text column; null texts have none."""

    @F.pandas_udf("array<float>")
    def f(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            have = s.dropna()
            for k in range(0, len(have), batch):
                part = have.iloc[k : k + batch]
                v = model.embed(part.tolist())
                if len(v) != len(part):
                    raise ValueError("the model gave another number of vectors than texts")
                for i, x in zip(part.index, v):
                    out[i] = x.tolist()
            yield out

    return f(col(text))


def cross_encoder(model: str, tokenizer: str, max_tokens: int = 512, batch: int = 32) -> Callable[[str], Callable[[Column], Column]]:
    """Relevance of texts to a query by a cross-encoder from local files, for ``fusion.rerank``."""

    def of_query(query: str) -> Callable[[Column], Column]:
        @F.pandas_udf("double")
        def f(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                got = []
                for k in range(0, len(s), batch):
                    r, feed, _ = _inputs(model, tokenizer, [(query, t or "") for t in s.iloc[k : k + batch]], max_tokens)
                    logits = np.asarray(r.run(None, feed)[0]).reshape(len(feed["input_ids"]), -1)
                    got += (1 / (1 + np.exp(-(logits[:, 1] if logits.shape[1] == 2 else logits[:, 0])))).tolist()
                yield pd.Series(got, index=s.index)

        return f

    return of_query
