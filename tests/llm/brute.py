"""Plain versions of the operators: whole table in memory, straight from the definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_pii(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def base_secrets(text: str) -> list[tuple[str, int, int]]:
    out = []
    key = "(password|passwd|secret|token|api_?key)"
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in key)
    for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def contaminated(texts: list[str | None], items: dict) -> list[tuple]:
    """(n_words, n_hit, n_items, items_sha256) per text."""
    windows = defaultdict(set)
    for item, text in items.items():
        words = ITEM_WORD.findall(lower(text or ""))
        n = min(10, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows[tuple(words[i:i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, found = ITEM_WORD.findall(lower(text or "")), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out.append((len(words), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def fingerprint(text: str | None, size: int = 4) -> int:
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    n = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(ids: list[int], fps: list[int], errors: int = 4) -> list[int]:
    least = list(ids)
    while True:
        new = [min(m for f, m in zip(fps, least, strict=True) if (f ^ g).bit_count() <= errors) for g in fps]
        if new == least:
            return least
        least = new


def without_repeats(sequences: list, length: int):
    """For each sequence which members stand under a window that also starts elsewhere."""
    starts = Counter(tuple(s[i:i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if starts[tuple(s[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append(gone)
    return out


def word_dedup(texts: list[str | None], length: int = 35) -> list[tuple]:
    words = [WORD.findall(t or "") for t in texts]
    return [(len(w), sum(g), sha(" ".join(x for x, gone in zip(w, g, strict=True) if not gone)))
            for w, g in zip(words, without_repeats(words, length), strict=True)]


def byte_dedup(texts: list[str | None], length: int = 200) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    return [(len(d), sum(g), sum(x and not (i and g[i - 1]) for i, x in enumerate(g)),
             sha(bytes(x for x, gone in zip(d, g, strict=True) if not gone)))
            for d, g in zip(data, without_repeats(data, length), strict=True)]


def quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i:i + 3])].append(i)
    repeated = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(repeated), n < 50 or 100 * len(repeated) > 50 * n)


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
