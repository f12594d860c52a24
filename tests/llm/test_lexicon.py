import numpy as np

from probelight.llm import toxicity as T


def test_rare_toxic_words_stay_beside_many_common_ones(spark):
    rng = np.random.default_rng(0)
    common = " ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (10_000, 10)))  # about 60,000 terms
    rows = [(common + (" zorvex" if i < 6 else ""), 1.0) for i in range(20)] + [(common, 0.0)] * 20
    lexicon = T.learned_lexicon(spark.createDataFrame(rows, "text string, label double"))
    assert T.word_hashes("zorvex")[0] in lexicon.hashes
    assert len(lexicon.hashes) < 100


def test_one_least_count_at_every_size(spark):
    for n in (20, 150):
        rows = [("calm water" + (" zorvex" if i < 4 else ""), 1.0) for i in range(n)] + [("calm water", 0.0)] * 20 * n
        assert T.word_hashes("zorvex")[0] in T.learned_lexicon(spark.createDataFrame(rows, "text string, label double")).hashes
