"""The fixed values, held against literals of their own."""

from lodestone.functions import fixed


def test_stop_words():
    assert "your" in fixed.TERM_STOP and {"my", "his", "our", "please"} <= set(fixed.TERM_STOP)
    assert [len(fixed.TOKEN_STOP), len(fixed.TERM_STOP), len(fixed.STUDY_STOP), len(fixed.QUERY_STOP)] == [29, 54, 38, 37]
    for words in (fixed.TOKEN_STOP, fixed.TERM_STOP, fixed.STUDY_STOP, fixed.QUERY_STOP):
        assert len(set(words)) == len(words) and all(w == w.lower() for w in words)


def test_numbers():
    assert (fixed.K1, fixed.B, fixed.RRF_K, fixed.CHANNEL_DEPTH) == (1.2, 0.75, 60, 48)
    assert (fixed.PASSAGE_CHARS, fixed.PASSAGE_BYTES, fixed.UNIT_CHARS) == (1800, 5500, 600)
    assert (fixed.WINDOW_CHARS, fixed.WINDOW_OVERLAP) == (2400, 200)
    assert (fixed.CANDIDATES, fixed.CONTEXT_SEEDS, fixed.PACK_BUDGET, fixed.GROUP_COST) == (24, 6, 24000, 64)
    assert (fixed.BATCH_ITEMS, fixed.BATCH_CHARS, fixed.MIN_REQUESTS) == (16, 12000, 2)
    assert fixed.FUSION_WEIGHTS == {"lexical": 1.0, "semantic": 0.9, "temporal": 0.85, "graph": 0.7, "path": 0.35, "path_multi_hop": 1.0, "model": 1.2}
    assert fixed.KIND_BONUS == {"daily": 0.0035, "fact": 0.003, "entity": 0.001, "concept": 0.0005}
