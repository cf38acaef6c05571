import random

import public_tokenizers
import pytest

CLASHING = ["id", "score", "found", "code", "key", "n", "word", "print", "s", "statistics", "counted", "kept", "path"]


def hard_texts() -> list[str | None]:
    rnd = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", "a", "The", "'s", "1", "2.", "é", " ", "　", "\x1c", "\x85", "ß", "漢字", "🙂", "▁", "!?", "́", "<|endoftext|>", "<s>"]
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    return ["", None, " ", "a", "a b", "x" * 30_000, "one two three " * 3000, *made]


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Odd texts, repeated rows, a null id, and extra columns whose names operators use themselves."""
    rows = [(i, t) for i, t in enumerate(hard_texts())]
    rows += [rows[6], rows[6], (None, "no id here"), (3, "another text of the same id")]
    rows = [(i, t, *["extra"] * len(CLASHING)) for i, t in rows]
    names = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path


@pytest.fixture
def texts_of():
    """Rows as sorted (id, text), ids that are null first."""
    return lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
