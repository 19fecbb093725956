"""Plain versions of the operators' definitions."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=DOCS, source=lambda i: f"s{i % 3}"):
    rows = [(i, t, "en", source(i), len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = "key row masks anchor range first n kept score tokens copy block position words wanted class_id comp sequence_id offset piece weight draw host page templates mid level".split()
    return df.withColumns({n: F.lit("x") for n in names})


def shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(texts):
    """{id: (shingles, smallest reachable id)} of {id: text}, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in texts}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed(texts, size=35):
    """[(words, removed, digest)] of a list of texts."""
    split = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {k for own in at.values() if len(own) > 1 for i in own for k in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)
