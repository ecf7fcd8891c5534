"""Plain versions that the operators are held against."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def smallest_reachable(ids, linked):
    """Smallest id reachable from each id over the pairs that linked tells."""
    label = {i: i for i in ids}
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if linked(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label
