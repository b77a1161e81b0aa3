"""Plain versions of what the operators compute."""

import re
from collections import Counter, defaultdict
from itertools import combinations

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def shingles(text, width):
    w = WORDS.findall(lower(text).encode())
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, width, num, den):
    sets = defaultdict(set)
    for i, t in docs:
        if i is not None:
            sets[i].add(shingles(t, width))
    links = [
        (a, b) for a, b in combinations(sorted(sets), 2)
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b])
    ]
    return joined(links, sets)


def line_dedup(docs, least=10):
    big = 1 << 63
    key = lambda line: lower(line.strip(STRIP))
    holder = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                k = key(line)
                holder[k] = min(holder.get(k, big), big - 1 if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        own = big - 1 if i is None else i
        left = [x for x in lines if len(key(x)) < least or holder[key(x)] == own]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def exact_groups(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[lower(t)].append(i)
    return groups


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(out)]


def counted(rows):
    return Counter(map(tuple, rows))
