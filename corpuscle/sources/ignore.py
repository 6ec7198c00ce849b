"""Ignore files: their rules, and which paths below them the last matching one leaves out."""

from __future__ import annotations

import os
import re

NAMES = (".gitignore", ".dockerignore", ".ignore")


def to_regex(rule: str) -> tuple[str, bool, bool] | None:
    """``(pattern over a path below the rule's folder, negated, for folders only)``; None for blanks and comments."""
    rule = rule.rstrip("\n\r")
    if not rule.endswith("\\ "):
        rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.removeprefix("/")
    if not rule:
        return None
    out, i = "", 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if rule.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := rule.find("]", i + 2)) > 0:
            body = rule[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        if c == "\\" and i + 1 < len(rule):
            out, i = out + re.escape(rule[i + 1]), i + 2
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return ("" if anchored else "(?:.*/)?") + out, negated, folder


class Rules:
    """The rules that hold in a folder: its own and those of the folders above it. The last one that matches decides."""

    def __init__(self, above: Rules | None, folder: str, names: tuple[str, ...] = NAMES):
        self.above, self.folder, self.own = above, folder, []
        for name in names:
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    found = [to_regex(line) for line in f]
            except OSError:
                continue
            self.own += [(re.compile(r[0] + r"\Z"), r[1], r[2]) for r in found if r]

    def ignored(self, path: str, is_dir: bool) -> bool:
        at: Rules | None = self
        while at is not None:
            rel = path[len(at.folder) :].lstrip("/")
            for pattern, negated, folders in reversed(at.own):
                if (is_dir or not folders) and pattern.match(rel):
                    return not negated
            at = at.above
        return False
