"""Small tables for the operators: nulls, empty texts, ties, repeats, long texts, extra columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, component_id string, row string"


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "Éa", "ΑΣ", "mit", "license", "x1", "a", "b-c", "w's", "ß", "naïve", "end."] + [f"w{i}" for i in range(40)]
    texts: list[str | None] = [None, "", "  \n\t", "one", "One two", "a a a a a a a a", "same line\nsame line\n\nsame line", "<|endoftext|> x <|ENDOFTEXT|>"]
    for i in range(n):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 60, 200]))))
    base = [f"t{rng.randrange(500)}" for _ in range(300)]
    for i in range(12):
        near = list(base)
        near[rng.randrange(300)] = f"edit{i}"
        texts.append(" ".join(near))
    texts.append(" ".join(base[:100] * 3))
    texts.append(" ".join(f"z{rng.randrange(3000)}" for _ in range(30_000)))
    out = [(i, t, "en", f"s{i % 3}", 0, "x", "y", "z") for i, t in enumerate(texts)]
    out += [out[10], out[10], (None, "a null id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
