"""A row-at-a-time model of the whole chain, to hold the DataFrame engine against."""

from __future__ import annotations

import re
import unicodedata

from silt.functions import text as T

TAG = T.TAG


def alnum(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "N"


def clean(line: str) -> str:
    if "\x1b" not in line and "\r" not in line:
        return line
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if c == "\x1b":
            kind = line[i + 1 : i + 2]
            i += 2
            if kind == "[":
                while i < len(line) and not "@" <= line[i] <= "~":
                    i += 1
                i += 1
            elif kind == "]":
                while i < len(line) and line[i] != "\x07" and line[i : i + 2] != "\x1b\\":
                    i += 1
                i += 2 if line[i : i + 1] == "\x1b" else 1
            continue
        if unicodedata.category(c) != "Cc" or c in "\t\r":
            out.append(c)
        i += 1
    shown: list[str] = []
    at = 0
    for c in out:
        if c == "\r":
            at = 0
        else:
            shown[at : at + 1] = [c]
            at += 1
    return "".join(shown)


def strip_ends(w: str) -> str:
    a, b = 0, len(w)
    while a < b and not alnum(w[a]):
        a += 1
    while b > a and not alnum(w[b - 1]):
        b -= 1
    return w[a:b]


def decoration(text: str) -> bool:
    for w in text.split():
        core = strip_ends(w)
        if core and core.lower() not in T.DECORATION_WORDS and not all(c in "0123456789." for c in core):
            return False
    return True


def progress(line: str) -> bool:
    t = line.strip()
    if not t:
        return False
    if any(t.startswith(v + " ") and len(t) > len(v) + 1 for v in T.PROGRESS_VERBS):
        return True
    at = t.find("%")
    if at > 0:
        a = at
        while a and t[a - 1] in "0123456789.":
            a -= 1
        if a < at and decoration(t[:a]) and decoration(t[at + 1 :]):
            return True
    drawn = sum(c in T.BAR_CHARACTERS for c in t)
    return drawn >= T.BAR_LEAST and drawn * 4 >= len(t) * 3 or t[0] in T.SPINNERS


def reports(low: str, words: list[str]) -> bool:
    for w in words:
        s = low.lstrip()
        if s.startswith(w) and not (len(s) > len(w) and (alnum(s[len(w)]) or s[len(w)] == "_")):
            return True
        at = low.find(w)
        while at >= 0:
            after, before = low[at + len(w) : at + len(w) + 1], low[:at]
            if (not before or not alnum(before[-1])) and after and after in ":[(":
                return True
            lead = before.rstrip()
            if lead != before and lead and lead[-1] in "0123456789":
                return True
            at = low.find(w, at + 1)
    return False


def lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def failing(line: str) -> bool:
    low = lower(line)
    if any(p in low for p in T.FAILURE_PHRASES):
        return True
    first = low.split()[0] if low.split() else ""
    return first.endswith(":") and ("error" in first or "exception" in first) or reports(low, T.FAILURE_WORDS)


def testing(line: str) -> bool:
    low = lower(line)
    return "test" in low and any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", low) for w in T.TEST_FAILURE_WORDS)


def classify(lines: list[str]) -> str:
    for x in lines:
        if failing(x):
            return "Failure" if testing(x) else "Error"
    if any(reports(lower(x), T.WARNING_WORDS) for x in lines):
        return "Warning"
    return "Info" if any(alnum(c) for x in lines for c in x) else "Noise"


class Block:
    def __init__(self, lines, cls="Info", keep="Normal", reason=None):
        self.lines, self.cls, self.keep, self.reason = lines, cls, keep, reason

    def drop(self, reason):
        if self.keep != "Force":
            self.keep, self.reason = "Drop", reason

    def annotate(self, n):
        if f"[{TAG}: ×" not in self.lines[-1][1]:
            self.lines[-1] = (self.lines[-1][0], f"{self.lines[-1][1]}  [{TAG}: ×{n}]")

    def texts(self):
        return [t for _, t in self.lines]


def parse(raw: str) -> list[Block]:
    parts = raw.split("\n")
    lines = [p.removesuffix("\r") for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    blocks, now, continued = [], [], False
    for n, x in enumerate(lines, 1):
        if not x.strip():
            if now:
                blocks.append(Block(now))
            now, continued = [], False
            continue
        indented = x[0] in " \t"
        gutter = x.lstrip("0123456789").lstrip().startswith(("|", "=", "^", "..."))
        if indented:
            continued = continued or bool(now)
        elif not gutter:
            if continued:
                blocks.append(Block(now))
                now = []
            continued = False
        now.append((n, x))
    if now:
        blocks.append(Block(now))
    return blocks


def run(raw: str, stream: str, exit_code: int, reach: int = 3) -> list[Block]:
    blocks = parse(raw)
    for b in blocks:
        b.lines = [(n, clean(x)) for n, x in b.lines]
        if all(progress(t) for t in b.texts()):
            b.cls = "Progress"
            b.drop("progress")
    out = []
    for b in blocks:
        if b.keep == "Drop":
            out.append(b)
            continue
        rest, i = [], 0
        while i < len(b.lines):
            j = i
            while j < len(b.lines) and b.lines[j][1] == b.lines[i][1]:
                j += 1
            if j - i >= 3:
                if rest:
                    out.append(Block(rest))
                rest = []
                one = Block([b.lines[i]])
                one.annotate(j - i)
                copies = Block(b.lines[i + 1 : j])
                copies.drop("dedupe")
                out += [one, copies]
            else:
                rest += b.lines[i:j]
            i = j
        if rest:
            out.append(Block(rest))
    blocks, i = out, 0
    while i < len(blocks):
        j = i + 1
        if blocks[i].keep != "Drop":
            while j < len(blocks) and blocks[j].keep != "Drop" and blocks[j].texts() == blocks[i].texts():
                blocks[j].drop("dedupe")
                j += 1
            if j > i + 1:
                blocks[i].annotate(j - i)
        i = j
    live = [b for b in blocks if b.keep != "Drop"]
    keys = [re.sub("[0-9]+", "#", "\n".join(b.texts())) for b in live]
    if len(live) >= 6:
        for w in range(min(8, len(live) // 3), 1, -1):
            s = 0
            while s + 3 * w <= len(live):
                r = 1
                while keys[s + r * w : s + (r + 1) * w] == keys[s : s + w]:
                    r += 1
                if r >= 3:
                    for b in live[s + w : s + w * r]:
                        b.drop("dedupe")
                    live[s + w - 1].annotate(r)
                    s += w * r
                else:
                    s += 1
    for b in blocks:
        if b.cls != "Progress":
            b.cls = classify(b.texts())
    bad = [i for i, b in enumerate(blocks) if b.cls in ("Error", "Failure")]
    if exit_code and not bad:
        for b in blocks[-(5 if stream == "stderr" else 3) :]:
            if b.cls != "Progress":
                b.keep, b.reason = "Force", None
    for i, b in enumerate(blocks):
        if b.cls != "Progress" and any(abs(i - k) <= reach for k in bad):
            b.keep, b.reason = "Force", None
    return blocks


def marker(lines: int, reason: str, blocks: int) -> str:
    what = f"{lines} lines in {blocks} blocks" if blocks > 1 else f"{lines} line{'' if lines == 1 else 's'}"
    return f"[{TAG}: {what} outside this view · {reason}]\n"


def render(blocks: list[Block], level: int) -> str:
    if not blocks:
        return ""
    total = sum(len(b.lines) for b in blocks)
    bad = sum(b.cls in ("Error", "Failure") for b in blocks)
    if level == 0:
        warned = sum(b.cls == "Warning" for b in blocks)
        return f"{total} lines · {bad} failing · {warned} warning{'' if warned == 1 else 's'}\n" + marker(total, "level 0 shows counts only", 1)
    out, lines, count = "", 0, 0
    for b in [*blocks, None]:
        if b is None or (b.keep != "Drop" and not (level == 1 and b.cls not in ("Error", "Failure"))):
            if lines:
                out += marker(lines, "filtered", count)
            lines = count = 0
            if b is not None:
                out += "".join(t + "\n" for t in b.texts())
        else:
            lines, count = lines + len(b.lines), count + 1
    return out
