"""Plain Python versions of what the operators return, written from their contracts."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FORMATS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        d = int(digit) * (2 if place % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_data(text):
    found = []
    for rank, (kind, pattern) in enumerate(FORMATS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(part) <= 255 for part in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def personal_row(doc_id, text):
    spans = personal_data(text)
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
    counts = [sum(kind == s[2] for s in spans) for kind in FORMATS]
    return (doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest()), joined


def quality_base(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeats = sum(line in lines[:i] for i, line in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return doc_id, len(words), sum(map(len, words)), symbols, repeats, len(covered), failed


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(rows, k, percent):
    """Smallest id reachable by links, and the set size, of (id, text) rows."""
    sets = {i: shingles(text, k) for i, text in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}
