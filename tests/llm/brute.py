"""Plain versions of what the operators compute."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)}


def least_of(nodes, links):
    """Each node's least reachable node."""
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def jaccard_groups(texts, percent=75):
    """{id: (set size, component)} of {id: [texts]}; an id with several texts is one node."""
    sets = [(i, shingles(t)) for i, ts in texts.items() for t in ts]
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and i != j and 100 * both >= percent * (len(a) + len(b) - both):
                links.append((i, j))
    return least_of(texts, links)


def base_counts(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[k : k + 8]) for k in range(len(found) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {p for k, w in enumerate(windows) if w in twice for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def passes_rules(text):
    text = text or ""
    n, chars, symbols, doubles, repeated = base_counts(text)
    found = WORD.findall(text)
    letters = [c for c in text if c.isalpha()]
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    stutter = sum(a == b for a, b in zip(found, found[1:]))
    bad = n < 20 or 100 * repeated > 30 * n or 5 * symbols > n or 2 * sum(c.isupper() for c in letters) > len(letters)
    return not (bad or 2 * doubles > lines or 10 * stutter > 3 * n or chars < 2 * n or chars > 30 * n)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing the excess again and again; sizes by source, None last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    goal, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = goal - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in free)
        got = {s: most * sizes[s] if s in capped else weight[s] * left / total for s in order}
        over = {s for s in free if got[s] > most * sizes[s]}
        if not over:
            return got
        capped |= over


def without(text, drops):
    """The text without the lines that go."""
    return "\n".join(x for x in text.split("\n") if not drops(x))


def mixed_copies(rows, seed, most=2):
    """Copies of each row (source, size, class, draw, tie) that the mix takes, row by row:
    whole ones, and one more of those that Pareto sampling picks in the source's classes."""
    sizes = {}
    for s, size, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size
    goals, out = targets(sizes, most=most), [0] * len(rows)
    for s, total in sizes.items():
        whole = math.floor(goals[s] / total) if total else 0
        mine = [k for k, r in enumerate(rows) if r[0] == s]
        for k in mine:
            out[k] = whole
        missing = round(goals[s]) - whole * total
        owed = 0.0
        for cls in sorted({rows[k][2] for k in mine if rows[k][1]}, reverse=True) if missing > 0 else []:
            part = [k for k in mine if rows[k][2] == cls and rows[k][1]]
            words = sum(rows[k][1] for k in part)
            owed += missing / total * words
            name = "n" if s is None else "s" + s
            below = sum(rows[k][1] for k in mine if rows[k][2] < cls)
            u = 0.5 if words / len(part) > min(missing / total, 1 - missing / total) * below else int.from_bytes(hashlib.blake2b(f"{seed} {cls} {name}".encode(), digest_size=7).digest(), "big") / 2**56
            n = int(min(len(part), max(0, math.floor(owed / (words / len(part)) + u))))
            p = inclusion_probabilities([rows[k][1] for k in part], n)
            owed -= sum(x * rows[k][1] for k, x in zip(part, p))
            ranks = []
            for k, x in zip(part, p):
                v = (((rows[k][3] % 2**64) >> 11) + 0.5) / 2**53
                q = v * (1 - x) / ((1 - v) * x) if 0 < x < 1 else 0.0
                ranks.append((max(1, math.floor(q / (1 + q) * 2**52)) if x < 1 else 0, rows[k][4]))
            order = sorted(set(ranks))
            before = 0
            for r in order if n else []:
                group = [k for k, x in zip(part, ranks) if x == r]
                for k in group[: max(0, n - before)]:
                    out[k] += 1
                before += len(group)
    return out


def inclusion_probabilities(sizes, n):
    """In proportion to size, 1 at most, summing up to n."""
    certain = set()
    while True:
        rest = sum(s for s in sizes if s not in certain)
        left = n - sum(s in certain for s in sizes)
        more = {s for s in sizes if s not in certain and left * s >= rest}
        if not more:
            return [1.0 if s in certain else s / (rest / left) if left else 0.0 for s in sizes]
        certain.add(max(more))
