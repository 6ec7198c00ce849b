"""Credentials embedded in source code: found in plain and encoded text, and masked in place.

One pass of a multi-pattern automaton over a text finds where a credential may be near; only there are the
detectors tried: private key blocks, tokens of well-known shapes, passwords in URLs, authorization headers,
and literals given to credential-like names (also in connection strings). Literals joined with ``+`` over
several lines count as one value. Placeholders, empty values, references to values kept elsewhere, checksums,
identifiers and public keys are not credentials.

Encoded literals (base64, hex, percent and backslash escapes) are decoded, and what they hold is scanned
again, layer by layer until nothing is left to decode; decoded bytes are also parsed as key containers by their
binary grammar (DER: PKCS#1, PKCS#8 plain or encrypted, PKCS#12 and SEC1; OpenSSH key files; OpenPGP secret
keys) and read as UTF-8 or UTF-16. A credential found inside makes the enclosing literal a credential.

Chunks are cut from documents, so a chunk holds a credential if it holds the whole of one found in its
document, even where the name it was given to is cut off; chunks are also scanned by themselves.

Masking keeps every length, quote, line break and key mark, so code still parses and offsets still hold.

Defined results: null and empty texts hold nothing; each id stands for itself, copies too; repeated rows
count once; texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class Found(NamedTuple):
    start: int
    end: int
    kind: str


#: Words near which a credential may stand, in lower case.
TRIGGERS = ("pass", "pwd", "pw ", "pw=", "pw:", "pw\"", "pw'", "pw`", "secret", "token", "key", "auth", "bearer ", "basic ", "://", "-----begin", "credential", "akia", "asia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "xox", "sk_live_", "rk_live_", "sk_test_", "npm_", "aiza", "sg.", "eyj", "hf_", "pypi-", "ya29.", "dop_v1_", "sk-", "shpat_")

#: Shapes of well-known tokens.
SHAPES = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{18,}|xox[abeprs]-[A-Za-z0-9-]{18,}|[srp]k_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|AIza[\w-]{30,}"
    r"|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|ya29\.[\w-]{20,}|dop_v1_[0-9a-f]{40,}|shpat_[0-9a-fA-F]{30,}|sk-[A-Za-z0-9_-]{32,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9_])"
)
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'`@/:<>{}$]*:([^\s\"'`@/]+)@[A-Za-z0-9\[]")
HEADER = re.compile(r"(?i)\b(?:bearer|basic)\s+([A-Za-z0-9+/_.~=-]{12,})")
NAMED = re.compile(
    r"(?i)(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]{0,60}?(?:pass(?:word|wd|phrase)?|pwd|pw|secret|token|key|credentials?))[\"'`]?\]?\s*(?::\s*(?:&'?\w*\s*)?(?:str|String)\s*=|:=|=>|==?=?|:|(?<=[\s\"'`])(?:is|to)(?=\s))\s*"
)
QUOTED = re.compile(r"[bruf@]{0,2}(\"\"\"|'''|[\"'`])")
PIECE = re.compile(r"\s*(?:\\\s*)?[+.]?\s*(?:\\\s*)?([\"'`])((?:\\.|(?!\1)[^\\\n])*)\1")
BARE = re.compile(r"[^\s\"'`;,(){}\[\]<>$&|](?:[^\s\"'`;,(){}\[\]<>$&|]|\$(?![\w({]))*")
#: A bare value within words, as in a comment, a note or a string.
NOTED = re.compile(r"(?=[^\s\"'`]*\d)(?=[^\s\"'`]*[A-Za-z])[^\s\"'`,;(){}\[\]<>]{6,}(?=[\"'`]|[.,;]?[^\S\n]*(?:\n|\*/|$))")
COMMENTED = re.compile(r"(?:^|\s)(?://|#|\*|/\*|--|;|<!--|%)")
#: Where a token ends for sure.
TOKEN_END = re.compile(r"[\s\"'`]")
#: A bare value that can't be code or prose, as in a comment.
STRONG = re.compile(r"(?=[^\s]*\d)(?=[^\s]*[a-z])(?=[^\s]*[A-Z])[A-Za-z0-9+/=~!@#%^*?-]{16,}")
#: Values that stand for a credential, and references.
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|1234\d*|<.*>|\{.*\}|\$.*|%.*%|%s|\[.*\]|@.*@|.*\$\{.*\}.*|.*\{\{.*|(?:your|my|the|insert|enter|put|add|replace|change|example|sample|dummy|fake|test|todo|tbd|fixme|redacted|masked|hidden|removed|none|null|nil|true|false|string|text|value|undefined|default|placeholder|secret|password|passwd|token|key|apikey|bearer|basic|strict|user|username|pass|admin|changeme|change_me|env|vault)(?:[\W_].*)?|.*(?:_here|-here|example|placeholder|changeme|replace_?me|your[_-]).*|.*[*x]{6,}.*)$"
)
REFERENCE = re.compile(r"(?i)^(?:env|vault|secret|ssm|file|arn|aws|gcp|kms|op|ref|config|process|os|settings|prod|dev|staging)[:./].*|^/.*|^\.{1,2}/.*|^(?![A-Za-z]+\.[A-Za-z]+\d{2,}$)[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$")
PUBLIC = {"public", "pub", "primary", "foreign", "sort", "partition", "cache", "next", "prev", "previous", "page", "continuation", "cursor", "csrf", "idempotency", "object", "bucket", "row", "hash", "index", "lookup", "map", "dict", "json", "group", "join", "unique", "natural", "surrogate", "candidate", "routing", "message", "translation", "i18n", "ssh", "host", "fingerprint", "publishable", "site", "lexer", "start", "end", "stop", "eos", "bos", "pad", "unk", "mask", "sep", "cls"}
PASSWORDS = {"password", "passwd", "pass", "pwd", "passphrase", "pw"}
CONFIG = {"env", "conf", "cfg", "ini", "properties", "toml", "yaml", "yml", "sh", "bash", "zsh", "md", "markdown", "txt", "rst"}

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _automaton():
    a = ahocorasick.Automaton()
    for t in TRIGGERS:
        a.add_word(t, len(t))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _classes(v: str) -> int:
    return sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))


def _placeholder(v: str) -> bool:
    return bool(PLACEHOLDER.match(v)) or bool(REFERENCE.match(v)) or len(set(v)) < 3


def credential_value(name: str, value: str) -> bool:
    """Whether a literal given to this name is a live-looking credential."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or _placeholder(value) or any(c.isspace() for c in value):
        return False
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last in PASSWORDS:
        return 6 <= len(value) <= 200 and (bool(re.search(r"\d", value)) or bool(re.search(r"[^\W_]", value[1:]) and re.search(r"(?<=.)[A-Z]", value) and re.search(r"[a-z]", value)) or (_classes(value) >= 2 and bool(re.search(r"[^\w./-]", value))))
    if before in PUBLIC or (last == "key" and len(parts) == 1) or last in ("publickey", "primarykey"):
        return False
    mixed = bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value)) or (bool(re.search(r"(?<=.)[A-Z]", value)) and bool(re.search(r"[a-z]", value)) and "_" not in value and "-" not in value)
    least = 8 if last in ("secret", "token") and _classes(value) >= 3 else 12
    return len(value) >= least and mixed and entropy(value) >= 2.8 and not re.fullmatch(r"[a-z]+(?:[-_/.][a-z0-9]+)+|[A-Za-z]+(?:[_.][A-Za-z]+)+", value)


JOIN = re.compile(r"\s*(?:\\\s*)?\+\s*(?:\\\s*)?|\s*\\\n\s*(?=[\"'])")
REST = re.compile(r"[^\S\n]*([^\s])?")


def _read_literal(text: str, at: int, loose: bool, lines: bool) -> tuple[int, int, str, bool] | None:
    """``(start, end, value, whole)`` of the literal that begins at this place, with those joined to it."""
    if at >= len(text):
        return None
    q = QUOTED.match(text, at)
    if q and len(q.group(1)) == 3:
        end = text.find(q.group(1), q.end())
        return (q.end(), end, text[q.end() : end], True) if end > 0 else None
    if q:
        first = PIECE.match(text, q.start(1))
        if not first:
            return None
        value, end, whole = [first.group(2)], first.end(2), True
        pos = first.end()
        while j := JOIN.match(text, pos):
            nxt = PIECE.match(text, j.end())
            if not nxt:
                whole = j.end() < len(text)  # else the text ends where the next part should be
                break
            end, pos = nxt.end(2), nxt.end()
            value.append(nxt.group(2))
        return first.start(2), end, "".join(value), whole
    if b := BARE.match(text, at):
        if not loose and not STRONG.fullmatch(b.group()):
            return None
        rest = REST.match(text, b.end()).group(1)
        if rest and rest not in "#;,\"'`" and lines:
            return None  # an expression or prose, not a bare value
        return b.start(), b.end(), b.group(), True
    return None


def _noted(text: str, start: int, at: int, name: str) -> tuple[int, int, str, bool] | None:
    """A value given to a password's or token's name in a comment or inside a string."""
    if [p.lower() for p in _PARTS.findall(name)][-1:] not in [[n] for n in (*PASSWORDS, "token", "secret")]:
        return None
    line = text[max(0, start - 400) : start].rpartition("\n")[2]
    m = NOTED.match(text, at)
    if not m or not (COMMENTED.search(line) or line.count('"') % 2 or line.count("'") % 2):
        return None
    v = m.group().rstrip(".,;") if text[m.end() : m.end() + 1] in ("", "\n") else m.group()
    return (m.start(), m.start() + len(v), v, True)


def _windows(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one, each going on to the end of the token it ends in."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and b <= out[-1][1]:
            continue
        m = TOKEN_END.search(text, b)
        b = m.start() if m else len(text)
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out


def _plain(text: str, path: str | None, low: str | None = None) -> list[Found]:
    """Credentials written plainly in the text; of overlapping ones the first kept is the longest known shape."""
    low = text.lower() if low is None else low
    same = len(low) == len(text)
    if not same:
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    ext = path.rsplit(".", 1)[-1].lower() if path and "." in path else ""
    loose = ext in CONFIG or bool(path) and path.rsplit("/", 1)[-1].startswith(".env")
    found, spans, last, lines = [], [], 0, "\n" in text
    for end, n in _AUTOMATON.iter(low):
        s = end + 1 - n
        if s < last:
            continue  # inside a span that is there already, far enough from its end
        a = max(text.rfind("\n", max(0, s - 200), s) + 1, s - 200, 0)
        b = text.find("\n", s, s + 600)
        b = b if b >= 0 else min(len(text), s + 600)
        last = b - 300
        spans.append((a, b))
    for a, b in _windows(text, spans):
        for m in BEGIN.finditer(text, a, b):
            e = END.search(text, m.end())
            nxt = BEGIN.search(text, m.end())
            if e and (not nxt or e.start() < nxt.start()) and not re.fullmatch(r"(?:[xn\W])*", text[m.end() : e.start()]):
                found.append(Found(m.start(), e.end(), "private_key"))
        for m in SHAPES.finditer(text, a, b):
            if not re.search(r"(?i)example|x{6}|\*{4}", m.group()):
                found.append(Found(m.start(), m.end(), "token"))
        for m in URL.finditer(text, a, b):
            if not _placeholder(m.group(1)) and len(m.group(1)) >= 4:
                found.append(Found(m.start(1), m.end(1), "url"))
        for m in HEADER.finditer(text, a, b):
            v = m.group(1)
            if len(v) >= 16 and not _placeholder(v) and re.search(r"\d", v) and re.search(r"[A-Za-z]", v):
                found.append(Found(m.start(1), m.end(1), "header"))
        for m in NAMED.finditer(text, a, b):
            lit = _read_literal(text, m.end(), loose, lines) or _noted(text, m.start(), m.end(), m.group(1))
            if lit is None and m.group(1).lower() in ("pwd", "password"):
                c = re.compile(r"[^;\s\"'`(){}\[\]<>$]+(?=[;\"'`])").match(text, m.end())
                lit = (c.start(), c.end(), c.group(), True) if c else None
            if lit and lit[3] and credential_value(m.group(1), lit[2]):
                found.append(Found(lit[0], lit[1], "named"))
    return found


B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){12,}(?![0-9A-Za-z])")
PERCENT = re.compile(r"[^\s\"'`<>]*(?:%[0-9A-Fa-f]{2}[^\s\"'`<>%]*){2,}")
ESCAPED = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}|[\w+/=:@.-])*(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){3,}(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}|[\w+/=:@.-])*")


def _layers(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Encoded literals of the text with their bytes."""
    for m in B64.finditer(text):
        s = m.group().rstrip("=")
        if len(s) % 4 == 1:
            continue
        try:
            yield m.start(), m.end(), base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4))
        except (binascii.Error, ValueError):
            pass
    for m in HEX.finditer(text):
        yield m.start(), m.end(), bytes.fromhex(m.group())
    if "%" in text:
        for m in PERCENT.finditer(text):
            yield m.start(), m.end(), unquote_to_bytes(m.group())
    if "\\x" in text or "\\u" in text or re.search(r"\\[0-7]{3}", text):
        for m in ESCAPED.finditer(text):
            try:
                yield m.start(), m.end(), re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\([0-7]{3})", lambda k: chr(int(k.group(1) or k.group(2) or k.group(3), 8 if k.group(3) else 16)), m.group()).encode("utf-8", "surrogatepass")
            except ValueError:
                pass


def _der(b: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """``(tag, start, end)`` of the DER element at this place."""
    if at + 2 > len(b):
        return None
    tag, n, p = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or p + k > len(b):
            return None
        n, p = int.from_bytes(b[p : p + k], "big"), p + k
    return (tag, p, p + n) if p + n <= len(b) else None


def _elements(b: bytes, at: int, end: int, most: int = 12) -> list[tuple[int, int, int]] | None:
    """The DER elements that fill the range exactly."""
    out = []
    while at < end and len(out) < most:
        e = _der(b, at)
        if not e or e[2] > end:
            return None
        out.append(e)
        at = e[2]
    return out if at == end else None


def _strings(b: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """``n`` strings with their length before them, as SSH writes them, and where they end."""
    out = []
    for _ in range(n):
        if at + 4 > len(b):
            return None
        k = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + k > len(b):
            return None
        out.append(b[at + 4 : at + 4 + k])
        at += 4 + k
    return out, at


def _openssh(b: bytes) -> bool:
    """Cipher, key derivation and its options, the number of keys, each public key, and the private part, with its check numbers where it isn't encrypted."""
    head = _strings(b, 15, 3)
    if not head or head[1] + 4 > len(b):
        return False
    (cipher, _, _), at = head
    keys = int.from_bytes(b[at : at + 4], "big")
    body = _strings(b, at + 4, keys + 1) if 1 <= keys <= 64 else None
    if not body or body[1] != len(b):
        return False
    private = body[0][-1]
    return len(private) >= 8 and len(private) % 8 == 0 and (cipher != b"none" or private[:4] == private[4:8])


def _pgp(b: bytes) -> bool:
    """An OpenPGP secret key or subkey packet of a known version whose length fits."""
    if len(b) < 20 or not b[0] & 0x80:
        return False
    if b[0] & 0x40:
        tag, first = b[0] & 0x3F, b[1]
        n, at = (first, 2) if first < 192 else ((first - 192 << 8) + b[2] + 192, 3) if first < 224 else (int.from_bytes(b[2:6], "big"), 6)
    else:
        tag, size = b[0] >> 2 & 15, (1, 2, 4, 0)[b[0] & 3]
        n, at = int.from_bytes(b[1 : 1 + size], "big"), 1 + size
    return tag in (5, 7) and size_fits(n, at, len(b)) and b[at] in (3, 4, 5, 6)


def size_fits(n: int, at: int, size: int) -> bool:
    return n >= 16 and at + n <= size


#: The identifiers of password-based encryption schemes begin so, and that of the data of a PKCS#12 file is this.
PBE = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")
PKCS7_DATA = bytes.fromhex("2a864886f70d0107")


def key_container(b: bytes) -> bool:
    """Whether the bytes are a private key: PKCS#1, PKCS#8 (plain or encrypted), PKCS#12, SEC1, OpenSSH or OpenPGP."""
    if b.startswith(b"openssh-key-v1\x00"):
        return _openssh(b)
    if b[:1] != b"\x30":
        return _pgp(b)
    top = _der(b)
    if not top or top[2] - top[1] < 16:
        return False
    parts = _elements(b, top[1], top[2])
    if not parts:
        return False
    tags = [e[0] for e in parts]
    inner = _elements(b, *parts[tags.index(0x30)][1:]) if 0x30 in tags else None
    kind = b[inner[0][1] : inner[0][2]] if inner and inner[0][0] == 6 else b""
    if tags == [0x30, 4]:
        return kind.startswith(PBE) and parts[1][2] - parts[1][1] >= 16
    if tags[0] != 2:
        return False
    version = int.from_bytes(b[parts[0][1] : parts[0][2]], "big")
    if version == 3:
        return tags[1:2] == [0x30] and kind.startswith(PKCS7_DATA)
    return version in (0, 1) and (tags[:9] == [2] * 9 or (tags[:3] == [2, 0x30, 4] and inner is not None and inner[0][0] == 6) or (version == 1 and tags[:2] == [2, 4]))


def _text_of(b: bytes) -> str | None:
    """The bytes as text, in UTF-8 or UTF-16, if that is what they are."""
    if len(b) < 8:
        return None
    for code in ("utf-8", "utf-16-le" if b[1] == 0 else "utf-16-be" if b[0] == 0 else "utf-16" if b[:2] in (b"\xff\xfe", b"\xfe\xff") else None):
        try:
            t = b.decode(code) if code else ""
        except UnicodeDecodeError:
            continue
        if t and all(c.isprintable() or c in "\n\r\t" for c in t):
            return t
    return None


def _holds(b: bytes) -> bool:
    """Whether decoded bytes hold a credential, in whatever depth: each layer is shorter than the one around it, so this ends."""
    seen, todo = set(), [b]
    while todo:
        b = todo.pop()
        if b in seen:
            continue
        seen.add(b)
        if key_container(b):
            return True
        t = _text_of(b)
        if t is not None:
            if _plain(t, ".env" if "\n" in t else None):
                return True
            todo += [x for _, _, x in _layers(t) if len(x) < len(b)]
    return False


def find(text: str | None, path: str | None = None) -> list[Found]:
    """All credentials of a text in order, without overlaps."""
    if not text:
        return []
    found = _plain(text, path)
    found += [Found(a, b, "encoded") for a, b, x in _layers(text) if _holds(x)]
    out: list[Found] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def mask(text: str | None, path: str | None = None) -> str | None:
    """The text with every credential's letters and digits masked; all else, and every length, is kept."""
    if not text:
        return text
    out, at = [], 0
    for f in find(text, path):
        s = text[f.start : f.end]
        if f.kind == "private_key":
            a, b = BEGIN.match(s).end(), END.search(s).start()
            s = s[:a] + re.sub(r"\\n|[A-Za-z0-9+/=]", lambda m: m.group() if m.group() == "\\n" else "x", s[a:b]) + s[b:]
        elif re.search(r"[\"'`]\s*(?:\\\s*)?\+", s):
            s = re.sub(r"((?:^|[\"'`])[^\"'`\n]*?)(?=[\"'`]|$)", lambda m: re.sub(r"[^\"'`\s+\\]", "x", m.group()), s)
        else:
            s = re.sub(r"[^\"'`\s]", "x", s)
        out += [text[at : f.start], s]
        at = f.end
    return "".join([*out, text[at:]])


def _scan(with_values: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, p in zip(b.id, b.text, b.path):
                line, at = 1, 0
                for f in find(t, p):
                    line, at = line + t.count("\n", at, f.start), f.start
                    rows.append((i, line, f.kind, " ".join(t[f.start : f.end].split()) if with_values else None))
            yield pd.DataFrame(rows, columns=["id", "line_no", "kind", "value"])

    return run


def in_documents(docs: DataFrame, id_col: str, text: str, path: str, with_values: bool = False) -> DataFrame:
    """``(id, line_no, kind, value)``: where each credential of each text begins."""
    d = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(path).alias("path"))
    return d.mapInPandas(_scan(with_values), "id string, line_no int, kind string, value string")


def in_chunks(chunks: DataFrame, id_col: str, text: str, document: str, found: DataFrame) -> DataFrame:
    """``id`` of each chunk that holds a whole credential: one found in its document (with its value), or one found in itself."""
    c = chunks.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(document).alias("doc"))
    inside = c.mapInPandas(_scan_chunks, "id string, doc string, text string, own boolean")
    own = inside.where("own").select("id")
    of_doc = found.select(F.col("id").alias("doc"), "value").distinct()
    cut_off = inside.where("NOT own").join(of_doc, "doc").where(F.contains("text", "value")).select("id")
    return own.unionByName(cut_off).distinct()


def _scan_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        own = [bool(find(t)) for t in b.text]
        yield pd.DataFrame({"id": b.id, "doc": b.doc, "text": [None if o else t for o, t in zip(own, b.text)], "own": own})


def masked(rows: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """The rows with the text's credentials masked."""
    if path is None:
        f = F.pandas_udf(lambda t: t.map(mask, na_action="ignore"), "string")
        return rows.withColumn(text, f(text))
    g = F.pandas_udf(lambda t, p: pd.Series([mask(x, y) for x, y in zip(t, p)]), "string")
    return rows.withColumn(text, g(F.col(text), F.col(path)))
