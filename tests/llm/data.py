"""Small awkward documents, shared by the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple]:
    base = prose(1, 60)
    words = base.split()
    texts = [
        base,
        base,
        " ".join([*words[:-2], "other", "end"]),
        " ".join([*words[:-12], *prose(2, 12).split()]),
        base.upper(),
        "",
        None,
        "one two",
        "one two",
        "\t\n ",
        "Ünïcode wörds — “quoted” İstanbul ſ ß 数字 數字 \U0001f600 end",
        "12345 67890 !!!",
        prose(3, 6000),
        prose(3, 5990) + " " + prose(9, 10),
        "x" * 3000,
    ]
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, None, None, 3), (None, None, None, None, None)]


def chain(n: int) -> list[tuple]:
    """Texts of which only neighbours are similar."""
    words = prose(5, 300).split()
    return [(100 + i, " ".join(words[i * 6 : i * 6 + 100]), "en", "web", 1) for i in range(n)]
