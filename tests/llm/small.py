"""Small tables with the awkward cases, and plain-Python counterparts."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    """A documents table; ``texts`` are texts or (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def story(seed, words=120):
    """Different words for different seeds, with line breaks."""
    import random

    r = random.Random(seed)
    made = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(words)]
    return "".join(w + ("\n" if r.random() < 0.1 else " ") for w in made).strip()


#: Null, empty, blank, short, long, repeated and odd texts.
ODD = [None, "", " ", "\n\n", "a", "one two", "one two three", "a  b", "tail ", " lead", "tab\tand\x0bmore\r\n",
       "é ü ñ 漢字 🦑", "x" * 5000, "w " * 3000 + "end", "same text here", "same text here", "<|endoftext|> it's 12 a.b",
       "▁ marks▁here", story(1), story(1), story(2)]


def edge_tables(spark):
    """The odd texts, with null and repeated doc_ids and rows, and the same table without rows."""
    pairs = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (None, None), (3, story(3)), (18, story(1))]
    full = documents(spark, pairs)
    return full, full.limit(0)
