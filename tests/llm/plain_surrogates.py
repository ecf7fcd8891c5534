"""A plain version of surrogate generation: one document after the other, loops and dictionaries."""

import hashlib
import struct
from collections import Counter

import regex
import xxhash

from statutegrid.llm import surrogates as S

FIND = regex.compile(S.ANY)
NAME = regex.compile(rf"(?<!\p{{L}}){S._NAME}")
TITLES = regex.compile(S._TITLES)
SECRET = regex.compile(r"(?s)" + S._SECRET_PARTS)
ISSUER = regex.compile(S._ISSUER)


def only_digits(x):
    return regex.sub("[^0-9]", "", x)


def luhn(number):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(number)))


def mod_97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def draw(seed, place, of):
    h = xxhash.xxh64_intdigest(struct.pack("<i", place), xxhash.xxh64_intdigest(seed.encode(), 42))
    return (h - 2**64 * (h >= 2**63)) % of


def digits(n, seed):
    return "".join(str(draw(seed, i, 10)) for i in range(n))


def letters(text, seed, alphabet=None):
    out = ""
    for i, c in enumerate(text):
        if regex.fullmatch("[0-9]", c):
            of = alphabet or "0123456789"
        elif script := next((s for s in ("cyrillic", "greek") if regex.fullmatch(rf"\p{{{s.title()}}}", c)), None):
            of = S._LOWER[script]
        elif c.isalpha():
            of = alphabet or S._LOWER["latin"]
        else:
            out += c
            continue
        out += of[draw(seed, i, len(of))]
    return out


def core(kind, norm, attempt, key):
    seed = hashlib.sha256("\u0001".join((key, kind, norm, str(attempt))).encode()).hexdigest()
    more = max(0, attempt - S.ATTEMPTS)
    if kind == "email":
        local, domain = norm.split("@")
        tail = "".join(S._LOWER["latin"][draw(seed, i + 900, 26)] for i in range(1, attempt + 1))
        return letters(local, seed) + tail + "@" + letters(domain.rpartition(".")[0], hashlib.sha256(seed.encode()).hexdigest()) + ".example"
    if kind == "secret":
        return letters(norm + "0" * more, seed, "0123456789abcdef" if regex.fullmatch("[0-9a-f]+", norm) else None)
    if kind == "iban":
        account = letters(norm[4:] + "0" * more, seed)
        return norm[:2] + f"{98 - mod_97((account + norm[:2] + '00').upper()):02d}" + account
    if kind == "ip":
        first = "10" if attempt < 3 else str(draw(seed, 0, 223) + 1)
        return ".".join([first, *(str(draw(seed, i, 256)) for i in (1, 2, 3))]) + ("." + digits(more, seed) if more else "")
    if kind == "phone":
        country, rest = norm.split(" ")
        return country + " " + digits(len(rest) + more, seed)
    if kind == "ssn":
        return digits(len(norm) + more, seed)
    if kind == "card":
        body = ISSUER.match(norm)[0]
        body += digits(len(norm) - 1 - len(body) + more, seed)
        return body + str(-luhn(body + "0") % 10)
    script = next((s for s in ("cyrillic", "greek") if regex.search(rf"\p{{{s.title()}}}", norm)), "latin")
    pick = lambda words, place: words.split()[draw(seed, place, len(words.split()))]
    return (pick(S._ONSETS[script], 0) + "".join(pick(S._MIDDLES[script], i + 10) for i in range(1, attempt + 3)) + pick(S._ENDS[script, kind], 1)).lower()


def entities(text):
    """(start, end, kind, mentions) of what a text holds."""
    out = []
    for m in FIND.finditer(text or ""):
        kind, surface = S.KINDS[m.lastindex - 1], m[0]
        if kind == "card" and not (ISSUER.match(only_digits(surface)) and luhn(only_digits(surface)) % 10 == 0):
            kind = None
        elif kind == "iban":
            solid = surface.replace(" ", "")
            kind = "iban" if mod_97(solid[4:] + solid[:4]) == 1 else None
        if kind == "person":
            titles = TITLES.match(surface)[1]
            words = [t.rstrip(".") for t in titles.split()]
            given = "given_f" if set(words) & set(S._FEMALE.split("|")) else "given_m" if set(words) & set(S._MALE.split("|")) else "given_n"
            names = surface[len(titles) + 1 :].split(" ")
            found = [("surname" if i == len(names) - 1 else given, w.lower(), w) for i, w in enumerate(names)]
        elif kind == "secret":
            found = [(kind, SECRET.match(surface)[2].lower(), None)]
        elif kind == "phone":
            country = m[0][: len(regex.match(r"(\+[0-9]{1,3})?", surface)[0])]
            found = [(kind, f"{country or '+1'} {only_digits(surface[len(country):])}", None)]
        elif kind in ("ssn", "card"):
            found = [(kind, only_digits(surface), None)]
        elif kind:
            found = [(kind, surface.replace(" ", "").lower(), None)]
        else:
            found = []
        out.append((m.start(), m.end(), kind, found))
    told = {}
    for *_, found in out:
        for kind, norm, _ in found:
            if kind in ("given_m", "given_f"):
                told.setdefault(norm, kind)
    return [(a, b, kind, [(told.get(n, k) if k == "given_n" else k, n, w) for k, n, w in found]) for a, b, kind, found in out]


def lay(surface, drawn, mark):
    out, at = "", 0
    for c in surface:
        if regex.fullmatch(mark, c):
            new = drawn[at : at + 1]
            out, at = out + (new.upper() if c.isupper() else new), at + 1
        else:
            out += c
    return out + drawn[at:]


def cased(word, drawn):
    if word.upper() == word and len(word) > 1:
        return drawn.upper()
    return drawn[0].upper() + drawn[1:] if word[0].isupper() else drawn


def capitals(x):
    return x.upper() == x != x.lower()


def written(kind, surface, cores):
    if kind is None:
        return surface
    drawn = cores[0]
    if kind == "email":
        if capitals(surface):
            return drawn.upper()
        over = lambda a, b: "".join(c.upper() if i < len(a) and a[i].isupper() else c for i, c in enumerate(b))
        return "@".join(over(a, b) for a, b in zip(surface.split("@"), drawn.split("@"), strict=True))
    if kind == "secret":
        head, body, tail = SECRET.match(surface).groups()
        return head + lay(body, drawn.upper() if capitals(body) else drawn, r"[\p{L}\p{N}_/+-]") + tail
    if kind == "phone":
        country = regex.match(r"(\+[0-9]{1,3})?", surface)[0]
        return country + lay(surface[len(country) :], drawn.split(" ")[1], "[0-9]")
    if kind == "person":
        titles = TITLES.match(surface)[1]
        return " ".join([titles, *map(cased, surface[len(titles) + 1 :].split(" "), cores)])
    return drawn if kind == "ip" else lay(surface, drawn.upper() if kind == "iban" else drawn, r"[\p{L}\p{N}]" if kind == "iban" else "[0-9]")


def settled(all_, key):
    """Surrogate of each (kind, norm): rounds in which all but one of those that clash draw again."""
    now = {e: (0, core(*e, 0, key)) for e in all_}
    while True:
        owner = {}
        for (kind, norm), (attempt, drawn) in now.items():
            owner[kind, drawn] = min(owner.get((kind, drawn), (attempt, norm)), (attempt, norm))
        again = [e for e, (attempt, drawn) in now.items() if owner[e[0], drawn] != (attempt, e[1]) or (e[0], drawn) in now]
        if not again:
            return {e: drawn for e, (_, drawn) in now.items()}
        attempt = max(a for a, _ in now.values()) + 1
        now |= {e: (attempt, core(*e, attempt, key)) for e in again}


def pseudonymised(texts, key):
    """(text, number of entities) of each text."""
    found = [entities(t) for t in texts]
    told = {}
    for es in found:
        for k, n in {(k, n) for *_, ms in es for k, n, _ in ms}:
            told.setdefault(n, Counter())[k] += 1
    same = {("given_n", n): ("given_m" if c["given_m"] > c["given_f"] else "given_f", n) for n, c in told.items() if c["given_n"] and c["given_m"] + c["given_f"]}
    cores = settled({(k, n) for es in found for *_, ms in es for k, n, _ in ms} - set(same), key)
    cores |= {e: cores[of] for e, of in same.items()}
    out = []
    for text, es in zip(texts, found, strict=True):
        names = {}
        for *_, ms in es:
            for kind, norm, word in sorted(ms, key=lambda m: m[0] == "surname"):
                if word and (kind == "surname" or names.get(word, ("", ""))[0] != "surname"):
                    names[word] = min(names[word], (kind, norm)) if word in names and names[word][0] != "surname" else (kind, norm)
        low = {}
        for word in sorted(names):
            low.setdefault(word.lower(), names[word])

        def one(m, names=names, low=low):
            if m[0] in names:
                return cased(m[0], cores[names[m[0]]])
            return cores[low[m[0].lower()]].upper() if capitals(m[0]) and len(m[0]) > 1 and m[0].lower() in low else m[0]

        swap = lambda part, one=one: NAME.sub(one, part)
        new, at = "", 0
        for a, b, kind, ms in es:
            new += swap(text[at:a]) + written(kind, text[a:b], [cores[k, n] for k, n, _ in ms])
            at = b
        out.append((text if text is None else new + swap(text[at:]), sum(k is not None for _, _, k, _ in es)))
    return out
