"""Plain versions of word shingles, links and components."""

import re


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components_of(ids, linked):
    ids, root = sorted(ids), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {x: find(x) for x in ids}


def jaccard_components(texts, percent=75):
    sets = {d: shingle_set(t) for d, t in texts.items()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x and y) and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y)

    return components_of(texts, linked)
