"""A small table of documents with every awkward case, and what the contracts call words."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return (text or "").encode().lower().split()


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def documents(seed=1):
    """Copies, near copies, shared lines, nulls, empties, ties, repeated rows, non-ASCII and a long text."""
    rng = random.Random(seed)
    rows = []
    base = [prose(rng, 60 + 5 * i) for i in range(12)]
    line = "This very line is shared by a number of documents, and it is long."
    for i, t in enumerate(base):
        rows.append((i, t))
        rows.append((100 + i, t + (" tail" if i % 2 else "")))
    for i in range(8):
        rows.append((200 + i, f"{prose(rng, 20)}\n  {line.upper() if i % 2 else line}\t\n{prose(rng, 15)}\n{line}"))
    rows += [(300, None), (301, ""), (302, "   \n\t"), (303, "one two"), (304, "ÉCOLE été naïve 漢字 😀 a b c d"), (305, "x " * 30_000), (306, "\n\n\n")]
    rows += [(307, "same row"), (307, "same row"), (None, "no id here"), (None, None), (308, "one two"), (309, prose(rng, 2000))]
    return [(d, t, "en" if (d or 0) % 3 else None, [None, "a", "b", "ü"][(d or 0) % 4], None if t is None else len(t)) for d, t in rows]
