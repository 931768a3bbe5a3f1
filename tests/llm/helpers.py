"""Small corpora and plain-Python versions to hold the operators against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "th on in er an re st tion ed es ing ha ou wh sh ea ble nd".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 2, 2, 3, 3, 4])))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


def corpus(n=60, seed=1):
    """Rows with near and exact copies, repeated lines, short, empty, null and long texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            words = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = word(rng)
            texts.append(" ".join(words))
        elif texts and kind < 0.35:
            texts.append((rng.choice(texts) or "") + "\n" + sentence(rng, 12) + "\n")
        else:
            texts.append("\n".join(sentence(rng, rng.choice([1, 3, 8, 20, 40])) for _ in range(rng.choice([1, 2, 5]))))
    texts += ["", None, "   \n\n ", "One", "one", "One two", "aé中 b c", "x " * 3000, "same line here again and again\n" * 5]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(7, rows[7][1], rows[7][2], "s", rows[7][4])]


def words(text, fold=False):
    if text is None:
        return []
    if fold:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def shingles(text, k):
    w = words(text, True)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def groups(n, links):
    """Smallest index reachable from each of n."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]
