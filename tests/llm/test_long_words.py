"""Unknown words of any length cost what their bits cost."""

import random

from riskloom.llm import context_mixing


def test_a_long_word_costs_its_bits(spark):
    rnd = random.Random(21)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [(k, " ".join(word(6) for _ in range(60))) for k in range(60)] + [(1000 + n, word(n)) for n in (200, 2000, 20000)]
    bits = {r.doc_id: -r.score / 0.30103 for r in context_mixing.score_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert bits[3000] > 4000 and 5 < bits[21000] / bits[3000] < 20 and 5 < bits[3000] / bits[1200] < 20  # 36 letters at random: five bits each
