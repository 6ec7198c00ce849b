"""Generated, minified, vendored and data files among source files, by linear support-vector classifiers.

One classifier per kind works on hashed character n-grams of the file (for vendored files: of its leading comment), on
hashed path components, and on the marks by which a file gives itself away: a generator's banner, a third-party licence
header or directory, the shape of minified or data lines. It learns from files that bear such marks, each in two
copies: as it is, and with its marks masked in text and path, so that the classifier learns what such files look like
besides. A second round drops training files without marks that the first takes for such a kind. Every file is judged
by the classifiers' outputs and nothing else, but for copies: a file with the very content of one found as vendored
is vendored.

Repositories are split between training and validation, so nothing is validated on a repository it was trained on. On
masked copies of held-out files a classifier must find at least ``RECALL`` of those that bore marks; that for vendored
files must also be right in ``TRUST`` of what it says, as their text is like anybody's. (For the other kinds files
without marks count as wrong though many are of the kind, so precision against marks is a lower bound only.) A
classifier that fails keeps the weights of its marks alone; ``report`` says which.

Fitting reads at most ``SAMPLE`` distinct contents, those with the smallest hash, and of each its ``TOP`` most frequent
n-grams, so its memory has a bound; it runs in one task on an executor. Every file is scored, with all its n-grams.

Defined results: only rows whose path has a code extension are judged; null and empty contents and null paths
are no cases; each id stands for itself, copies too; repeated rows count once; contents are read whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.words import MIX, mix
from corpuscle.session import cut

KINDS = ("generated", "minified", "vendored", "data")
BITS, ORDERS, SAMPLE, TOP, EPOCHS, TRUST, RECALL, SCALE = 15, (3, 4, 5), 4000, 4096, 12, 0.98, 0.9, 20.0
DIMS = 1 << BITS
PATH_DIMS = 1 << 12
PATH_WEIGHT, MARK_WEIGHT = 0.2, 4.0
#: Characters scored at once.
BLOCK = 1 << 20

#: Extensions of program code.
CODE = "py pyi js mjs cjs jsx ts tsx go rs kt kts java scala groovy cpp cc cxx c h hpp hh cs fs vb swift m mm rb php pl pm lua r jl dart ex exs erl hs ml clj sh bash zsh fish ps1 bat sql css scss less vue svelte proto asm s".split()
#: Directories that hold other people's code.
VENDOR_DIRS = "node_modules bower_components jspm_packages third_party third-party thirdparty 3rdparty vendor vendors vendored external externals extern deps Godeps Pods Carthage site-packages dist-packages".split()

COMMENT = r"^\s*(?://+|#+|/\*+!?|\*+|--+|;+|<!--)\s*"
BANNER = re.compile(
    COMMENT + r"(?:code generated by .*do not edit|@generated\b|<auto-?generated|auto-?generated by\b|(?:this (?:file|code|class|module) (?:is|was|has been) )?(?:automatically |auto-?)?generated (?:by|from|with|using) .*"
    r"|do not edit(?:\W*$| (?:this file|by hand|manually)\b)|manual (?:edits|changes) will be (?:lost|overwritten)|changes to this file (?:are|will be) lost)", re.I | re.M)
LICENCE = re.compile(
    COMMENT + r"(?:.*\((?:c)\) \d{4}[^\n]*\b(?:contributors|authors)\b[^\n]*licen[cs]e|bundled copy of\b|(?:this is an? )?(?:un)?modified copy of\b|vendored (?:copy|from)\b|imported from (?:its )?upstream|licen[cs]ed under [^\n]*(?:obtained|downloaded|taken) from|.*\bv?\d+\.\d+\.\d+ \| \(c\))", re.I | re.M)
SOURCE_MAP = re.compile(r"^\s*//[#@] sourceMappingURL=", re.M)
BLOB = re.compile(r"[A-Za-z0-9+/=]{40,}|(?:0x[0-9a-fA-F]{2,8}\s*,\s*){4,}|(?:-?\d+(?:\.\d+)?\s*,\s*){4,}|\{[^{}\n]{0,200}\}\s*,|(?:\\x[0-9a-fA-F]{2}){8,}")


class Evidence(NamedTuple):
    generated: bool
    minified: bool
    vendored: bool
    data: bool
    body: str  # what is left when the giveaways are masked
    head: str


def _lead(text: str) -> list[str]:
    """The lines of the leading comments, whole blocks included."""
    out, until, at = [], None, 0
    while at < len(text):
        nl = text.find("\n", at)
        l = text[at : nl if nl >= 0 else len(text)]
        t = l.strip()
        if until is None and not (not t or l.startswith("#!") or re.match(COMMENT, l)):
            break
        out.append(l)
        if until is None:
            until = "*/" if t.startswith("/*") else "-->" if t.startswith("<!--") else None
        if until is not None and until in t:
            until = None
        at += len(l) + 1
    return out if until is None else out[:1]  # a block that never ends is none


def vendor_dir(path: str) -> bool:
    return any(p in VENDOR_DIRS for p in path.split("/")[1:-1])


def evidence(text: str, path: str) -> Evidence:
    """By which kinds' marks a file gives itself away, and its text without them."""
    lead = _lead(text)
    head = "\n".join(lead)
    generated, vendored = bool(BANNER.search(head)), bool(LICENCE.search(head)) or vendor_dir(path)
    rest = text[len(head) :]
    lines = [l for l in rest.split("\n") if l.strip()]
    size = sum(map(len, lines)) or 1
    blank = sum(l.count(" ") for l in lines) / size
    blob = sum(len(m.group()) for m in BLOB.finditer(rest)) / size
    longest = max(map(len, lines), default=0)
    data = blob > 0.6
    minified = not data and ((longest > 400 and size / len(lines) > 200 and blank < 0.12) or (bool(SOURCE_MAP.search(text)) and longest > 200)) if lines else False
    body = SOURCE_MAP.sub("", rest)
    kept = "\n".join(l for l in lead if not BANNER.search(l) and not LICENCE.search(l))
    return Evidence(generated, minified, vendored, data, kept + "\n" + body, re.sub(r"[a-z]*\d[\w.]*|https?://\S+", "0", kept))


def path_features(path: str, masked: bool) -> np.ndarray:
    """Hashes of the path's directories and of the marks in its file name; of vendor directories only if not masked."""
    parts = path.split("/")
    name = parts[-1]
    marks = {f"d:{p}" for p in parts[1:-1] if not (masked and p in VENDOR_DIRS)} | {f"m:{m}" for m in re.findall(r"[._-]([A-Za-z]{1,12}[0-9]?)(?=[._-])", name)} | {f"f:{name.split('_')[0]}"}
    return np.array([DIMS + xxhash.xxh32_intdigest(m) % PATH_DIMS for m in sorted(marks)], "i4")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text's characters, and where each text's begin; digits are one character."""
    out, at = [], [0]
    raw = [re.sub(rb"[0-9]", b"0", t.encode("utf-8")) for t in texts]
    flat = np.frombuffer(b"\x00\x00\x00\x00\x00".join(raw) + b"\x00" * 8, "u1").astype("u8")
    starts = np.cumsum([0] + [len(r) + 5 for r in raw])
    with np.errstate(over="ignore"):
        hs, h = [], np.zeros(len(flat), "u8")
        for j in range(max(ORDERS)):
            h[: len(flat) - j] = (h[: len(flat) - j] * np.uint64(1099511628211)) ^ flat[j:]
            if j + 1 in ORDERS:
                hs.append((mix(h ^ np.uint64(j + 1) * MIX[0]) >> np.uint64(64 - BITS)).astype("i4"))
    for k, r in enumerate(raw):
        a, n = starts[k], len(r)
        for o, x in zip(ORDERS, hs):
            out.append(x[a : a + max(0, n - o + 1)])
        at.append(at[-1] + sum(max(0, n - o + 1) for o in ORDERS))
    return np.concatenate(out) if out else np.empty(0, "i4"), np.array(at)


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its distinct hashed n-grams and their shares."""
    h, at = grams(texts)
    out = []
    for k in range(len(texts)):
        idx, n = np.unique(h[at[k] : at[k + 1]], return_counts=True)
        out.append((idx.astype("i4"), (n * (SCALE / max(1, n.sum()))).astype("f4")))
    return out


class Model(NamedTuple):
    weights: np.ndarray  # one row per kind over n-grams, path components and the mark
    bias: np.ndarray
    used: tuple[bool, ...]
    report: dict[str, dict[str, float]]


class Example(NamedTuple):
    grams: np.ndarray
    shares: np.ndarray
    path: np.ndarray
    masked: np.ndarray  # path components without marks
    marked: bool


MARK = DIMS + PATH_DIMS


def _outputs(w: np.ndarray, b: float, x: Example) -> tuple[float, float]:
    """The classifier's outputs for the file as it is and for its masked copy."""
    text = float(w[x.grams] @ x.shares) + b
    return text + PATH_WEIGHT * float(w[x.path].sum()) + MARK_WEIGHT * float(w[MARK]) * x.marked, text + PATH_WEIGHT * float(w[x.masked].sum())


def _fit(x: list[Example], y: np.ndarray, lam: float = 1e-4) -> tuple[np.ndarray, float]:
    """Averaged sub-gradient descent on the hinge loss of both copies, classes weighted evenly."""
    w, b, ws, bs, t = np.zeros(MARK + 1, "f4"), 0.0, np.zeros(MARK + 1, "f4"), 0.0, 0
    cost = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    rng = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        eta = 0.5 / (1 + epoch)
        for k in rng.permutation(len(y)):
            e = x[k]
            whole, masked = (y[k] * o < 1 for o in _outputs(w, b, e))
            step = np.float32(eta * y[k] * cost[k])
            if whole:
                np.add.at(w, e.path, step * np.float32(PATH_WEIGHT))
                w[MARK] += step * np.float32(MARK_WEIGHT) * e.marked
            if masked:
                np.add.at(w, e.masked, step * np.float32(PATH_WEIGHT))
            if whole or masked:
                w[e.grams] += step * e.shares * np.float32((whole + masked) / 2)
                b += float(step) * 0.1
        w *= np.float32(1 - lam)
        ws, bs, t = ws + w, bs + b, t + 1
    return ws / t, bs / t


def _top(idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(idx) > TOP:
        keep = np.sort(np.argpartition(-val, TOP)[:TOP])
        idx, val = idx[keep], val[keep]
    return idx, val


PREPARED = "repo string, id string, given array<boolean>, bi array<int>, bv array<float>, hi array<int>, hv array<float>, path array<int>, masked array<int>, bare boolean"


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What fitting needs of each file."""
    for b in batches:
        for k in range(0, len(b), 64):
            part = b.iloc[k : k + 64]
            ev = [evidence(t, p) for t, p in zip(part.text, part.path)]
            body, head = ([_top(*f) for f in _features(x)] for x in ([e.body for e in ev], [e.head for e in ev]))
            yield pd.DataFrame({
                "repo": part.repo, "id": part.id, "given": [[getattr(e, c) for c in KINDS] for e in ev], "bi": [f[0] for f in body], "bv": [f[1] for f in body], "hi": [f[0] for f in head], "hv": [f[1] for f in head],
                "path": [path_features(p, masked=False) for p in part.path], "masked": [path_features(p, masked=True) for p in part.path], "bare": [not e.head.strip() for e in ev]})


def fit(sample: pd.DataFrame) -> Model:
    """Fit on prepared files: repositories whose hash falls into one of five are held out."""
    held = np.array([xxhash.xxh32_intdigest(str(r)) % 5 == 0 for r in sample.repo], bool)
    given = np.array(sample.given.tolist(), bool).reshape(-1, len(KINDS))
    bare = sample.bare.to_numpy(bool)
    weights, bias, used, report = np.zeros((len(KINDS), MARK + 1), "f4"), np.zeros(len(KINDS)), [], {}
    for c, kind in enumerate(KINDS):
        g, v = ("hi", "hv") if kind == "vendored" else ("bi", "bv")
        # What is left of a vendored file without a comment, once its directory is masked, is anybody's: only its marks are learned from.
        x = [Example(i, s, p, p if kind == "vendored" and o else m, bool(y)) for i, s, p, m, o, y in zip(sample[g], sample[v], sample.path, sample.masked, bare, given[:, c])]
        y = np.where(given[:, c], 1.0, -1.0)
        keep = ~held & (given[:, c] | ~given.any(axis=1) | (kind != "vendored"))
        weights[c, MARK], bias[c] = 1.0, -MARK_WEIGHT / 2
        fitted = (y[keep] > 0).sum() >= 5 and (y[keep] < 0).sum() >= 5
        report[kind] = {"fitted": float(fitted), "marked": float(given[:, c].sum())}
        used.append(bool(fitted))
        if not fitted:
            continue
        for _ in range(2):
            at = np.flatnonzero(keep)
            w, b = _fit([x[k] for k in at], y[at])
            s = np.array([_outputs(w, b, e)[1] for e in x])
            keep &= (y > 0) | (s < 0.3)  # likely such files without marks
        hv = held & (given[:, c] | ~given.any(axis=1))
        said, true = s[hv] > 0, y[hv] > 0
        p, r = (said & true).sum() / max(1, said.sum()), (said & true).sum() / max(1, true.sum())
        used[c] = bool((r >= RECALL or not true.any()) and (kind != "vendored" or p >= TRUST))
        report[kind] |= {"held_out": float(hv.sum()), "precision": float(p), "recall": float(r), "used": float(used[c])}
        if used[c]:
            weights[c], bias[c] = w, b
    return Model(weights, bias, tuple(used), report)


def code_rows(docs: DataFrame, id_col: str, path: str, text: str) -> DataFrame:
    """``(id, path, text, repo)`` of the rows with a code extension; the repository is the third directory of a full path, else the first."""
    parts = F.split(F.col(path), "/")
    ext = F.lower(F.element_at(F.split(F.element_at(parts, -1), r"\."), -1))
    repo = F.try_element_at(parts, F.when(F.startswith(F.col(path), F.lit("/")), F.lit(4)).otherwise(F.lit(1)))
    return docs.where(F.col(id_col).isNotNull() & F.col(path).isNotNull() & (F.length(text) > 0) & ext.isin(CODE)).select(F.col(id_col).cast("string").alias("id"), F.col(path).alias("path"), F.col(text).alias("text"), repo.alias("repo"))


def _fit_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if parts:
        m = fit(pd.concat(parts, ignore_index=True).sort_values("id", ignore_index=True))
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "bias": [m.bias.tobytes()], "used": [list(m.used)], "report": [json.dumps(m.report)]})


def train(code: DataFrame) -> Model:
    """A model from at most ``SAMPLE`` distinct contents.

    Only hashes and ids below a bound that leaves about twice the sample are sorted; texts are fetched afterwards.
    """
    keys = code.select("id", F.shiftrightunsigned(F.xxhash64("text"), 11).alias("h"))
    part = min(1.0, 2.0 * SAMPLE / max(1, keys.agg(F.approx_count_distinct("h")).head()[0]))
    few = keys.where(F.col("h") < int(part * (1 << 53))).groupBy("h").agg(F.min("id").alias("id")).orderBy("h").limit(SAMPLE)
    sample = code.join(F.broadcast(few.select("id")), "id", "left_semi").dropDuplicates(["id"])
    got = sample.select("id", "repo", "path", "text").mapInPandas(_prepare, PREPARED).repartition(1).mapInPandas(_fit_here, "weights binary, bias binary, used array<boolean>, report string").collect()
    if not got:
        return Model(np.zeros((len(KINDS), MARK + 1), "f4"), np.full(len(KINDS), -1.0), (False,) * len(KINDS), {})
    r = got[0]
    return Model(np.frombuffer(r.weights, "f4").reshape(len(KINDS), -1), np.frombuffer(r.bias), tuple(r.used), json.loads(r.report))


def _blocks(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = np.cumsum(b.text.map(len).to_numpy())
    at = 0
    while at < len(b):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
        yield b.iloc[at:end]
        at = end


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for whole in batches:
            for b in _blocks(whole):
                ev = [evidence(t, p) for t, p in zip(b.text, b.path)]
                texts = {"vendored": grams([e.head for e in ev]), "": grams([e.body for e in ev])}
                paths = [path_features(p, masked=False) for p in b.path]
                out = {"id": b.id, "h": [xxhash.xxh64_intdigest(t) >> 1 for t in b.text]}
                for c, kind in enumerate(KINDS):
                    h, at = texts["vendored" if kind == "vendored" else ""]
                    n = np.diff(at)
                    w = m.weights[c]
                    s = np.zeros(len(b))
                    some = n > 0
                    if m.used[c] and some.any():
                        s[some] = np.add.reduceat(w[h], at[:-1][some]) * (SCALE / n[some])
                    marked = np.array([getattr(e, kind) for e in ev])
                    out[kind] = s + [PATH_WEIGHT * w[f].sum() + m.bias[c] for f in paths] + MARK_WEIGHT * w[MARK] * marked
                    out[f"{kind}_given"] = marked
                yield pd.DataFrame(out)

    return run


def scored(docs: DataFrame, id_col: str, path: str, text: str, model: Model | None = None) -> DataFrame:
    """``id, h`` and of each kind its score and whether the file gives itself away, for every code file."""
    code = code_rows(docs, id_col, path, text)
    model = model or train(code)
    cols = ", ".join(f"{k} double, {k}_given boolean" for k in KINDS)
    return code.mapInPandas(_score(code.sparkSession.sparkContext.broadcast(model)), f"id string, h long, {cols}")


def not_handwritten(docs: DataFrame, id_col: str, path: str, text: str) -> DataFrame:
    """``id`` of each code file that nobody wrote by hand."""
    s = cut(scored(docs, id_col, path, text))
    alone = s.where(" OR ".join(f"{k} > 0" for k in KINDS)).select("id")
    third = s.where("vendored > 0").select("h").distinct()
    return alone.unionByName(s.join(third, "h", "left_semi").select("id")).distinct()


def composition(docs: DataFrame, id_col: str, path: str, text: str) -> DataFrame:
    """``(kind, files, without_marks)``: how many files the classifier of each kind finds, and how many of those bear no mark of it."""
    s = scored(docs, id_col, path, text)
    each = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) > 0).alias("found"), F.col(f"{k}_given").alias("given")) for k in KINDS])).alias("x")).select("x.*")
    return each.groupBy("kind").agg(F.count_if("found").alias("files"), F.count_if(F.col("found") & ~F.col("given")).alias("without_marks"))
