"""Small documents with every odd case: nulls, empty and blank texts, copies, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp int"


def prose(rng: random.Random, words: int, letters: str = "etaoinshrdlu") -> str:
    out = []
    while len(out) < words:
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) + (rng.choice([".", ",", ""]) if rng.random() < 0.2 else ""))
    lines, i = [], 0
    while i < words:
        n = rng.randint(8, 25)
        lines.append(" ".join(out[i : i + n]))
        i += n
    return "\n".join(lines)


def documents(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    passage = prose(rng, 70)
    texts += [t + "\n" + passage for t in texts[:5]]
    texts += [texts[7], texts[7], texts[8].replace(" ", "  ", 1)]
    words = texts[9].split(" ")
    texts.append(" ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 + 1 :]))
    texts += [None, "", " \n\t ", "one", "Ünïcode naïve — 日本語 text\nwith é", "same same same " * 40, prose(rng, 6000)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 9 == 0], None if t is None else len(t), "clash", 1))
    rows.append(rows[3])  # a repeated row
    return rows


def frame(spark, seed: int = 0):
    return spark.createDataFrame(documents(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
