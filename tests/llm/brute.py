"""Plain readings of the operators' contracts, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n, alphabet):
    out = list(text)
    for _ in range(n):
        kind, at = rng.random(), rng.randint(0, len(out))
        if kind < 0.35:
            out.insert(at, rng.choice(alphabet))
        elif out and kind < 0.7:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(alphabet)
    return "".join(out)


def dedup_lines(docs, edits, min_chars):
    first, seen = {}, []
    for d, t in sorted(x for x in docs if x[0] is not None and x[1] is not None):
        for p, line in enumerate(t.split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if len(line) >= min_chars:
                first.setdefault(line, (d, p))
                seen.append((d, p, line))
    lines, near = sorted(first, key=first.get), set()
    for i, x in enumerate(lines):
        near.update(y for y in lines[i + 1:] if abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits)
    gone = {(d, p) for d, p, x in seen if x in near or first[x] != (d, p)}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if d is None or (d, p) not in gone) for d, t in docs}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_classes(docs, k, percent):
    sets, parent = {d: shingles(t, k) for d, t in docs if d is not None}, {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def contamination(text, items, width=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        own = word.findall((t or "").translate(LOWER))
        n = min(width, len(own))
        grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i:i + n]) in grams:
                found.add(str(item))
                hit.update(range(i, i + n))
    return len(w), len(hit), sorted(found)


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def personal(text):
    return {k: [(m.start(), m.end(), m.group()) for m in re.finditer(p, text or "") if _valid(k, m.group())] for k, p in BASE.items()}
