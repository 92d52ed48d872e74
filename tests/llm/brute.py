"""Slow and plain versions of the operators' definitions, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def shingle_set(text):
    words = WORD.findall(lower_az(text or ""))
    if not words:
        return frozenset()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)])


def near(docs):
    """docs: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component_id)}."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by, ids = {}, sorted(sets)
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    count = {}
    for at in by.values():
        for k, a in enumerate(at):
            for b in at[k + 1 :]:
                count[a, b] = count.get((a, b), 0) + 1
    for (a, b), n in count.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
