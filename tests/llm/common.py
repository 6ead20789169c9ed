"""Plain-Python helpers of the operator tests."""
import re
import zlib

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def blank_words(text, fold=True):
    text = text or ""
    return BLANK.findall(text.translate(FOLD) if fold else text)


def alnum_words(text):
    return ALNUM.findall((text or "").translate(FOLD))


def rest(doc_id, parts):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def groups(nodes, links):
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def some_words(n, seed, choices=400):
    import random
    r = random.Random(seed)
    return [f"w{r.randrange(choices)}" for _ in range(n)]
