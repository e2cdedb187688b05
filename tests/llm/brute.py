"""Plain versions of the operators, word by word and pair by pair."""

import html
import re
import zlib
from collections import Counter

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def crc(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def line_measures(text):
    text = text or ""
    words = WHITE.findall(text)
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {k + j for k in range(len(words) - 2) if runs[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WHITE.search(x)]
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed


def normal_lines(text):
    """(normalised words, number of words) of each line with a word."""
    digits = str.maketrans("123456789", "000000000")
    lines = [WHITE.findall(x.translate(FOLD).translate(digits)) for x in (text or "").split("\n")]
    return [(tuple(x), len(x)) for x in lines if x]


def left_words(rows, name, least=5, percent=10, many=1000):
    """Words of each (id, host, text) that are in no line too many documents of the host hold; ``name`` says what a text counts as."""
    names, holders = {}, {}
    for _, host, text in rows:
        names.setdefault(host, set()).add(name(text or ""))
        for line, _ in normal_lines(text):
            holders.setdefault((host, line), set()).add(name(text or ""))
    def stays(host, line):
        n = len(holders[host, line])
        return n <= least or not (100 * n > percent * len(names[host]) or n > many)
    return {i: sum(n for line, n in normal_lines(text) if stays(host, line)) for i, host, text in rows}


def shingles(text):
    words = WHITE.findall((text or "").translate(FOLD))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def classes(rows):
    """{id: least id reachable} of (id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def hits(text, items):
    """Number of words, hit words and ids of items whose phrases occur."""
    words = ALNUM.findall((text or "").translate(FOLD))
    hit, found = set(), set()
    for item, other in items:
        own = ALNUM.findall((other or "").translate(FOLD))
        k = min(10, len(own))
        phrases = {tuple(own[j:j + k]) for j in range(len(own) - k + 1)} if k else set()
        for j in range(len(words) - k + 1):
            if k and tuple(words[j:j + k]) in phrases:
                hit |= set(range(j, j + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def base_secrets(text):
    text, out = text or "", []
    keyword = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    keyword += "|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", *m.span())] if len(m[1]) >= 8 else []
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def base_licences(text):
    words = ALNUM.findall((text or "").translate(FOLD))
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        own = phrase.split()
        for k in range(len(words)):
            if words[k:k + len(own)] == own:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)
