"""The score of op8 sums all segmentations of every word, known ones too."""

import math
import zlib
from collections import Counter

import numpy as np

from hostwin.llm import lattice
from hostwin.llm.queries import QUERIES, tokenizer_file
from tests.llm.test_texts import all_segmentations


def expected_by_enumeration(word, pieces):
    """Expected piece counts, by listing every way to cut a word."""
    text, out, total = lattice.START + word, Counter(), 0.0

    def walk(i, names, cost):
        nonlocal total
        if i == len(text):
            total += math.exp(cost)
            for n in names:
                out[n] += math.exp(cost)
        for j in range(i + 1, len(text) + 1):
            own = pieces.costs.get(text[i:j])
            if own is not None:
                walk(j, [*names, text[i:j]], cost + own)
            elif j == i + 1:
                walk(j, [*names, *[f"<0x{b:02X}>" for b in text[i:j].encode()]],
                     cost + sum(pieces.byte_costs[b] for b in text[i:j].encode()))
    walk(0, [], 0.0)
    return {n: c / total for n, c in out.items()}


def test_expected_counts_are_over_all_segmentations():
    path = tokenizer_file("piece_bpe_32k.model")
    pieces = lattice.weigh_pieces(path, np.zeros(lattice.processor(path).get_piece_size()), 5)
    for word in ("the", "nation", "一\U0001f642a"):
        got = {}
        lattice.count_pieces(word, pieces, 3.0, got)
        want = expected_by_enumeration(word, pieces)
        assert set(got) == set(want)
        assert all(math.isclose(got[n], 3 * c, rel_tol=1e-9) for n, c in want.items())


def test_score_is_the_marginal_of_every_word(spark, sf):
    path = tokenizer_file("piece_bpe_32k.model")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w.decode() for i in learned for w in lattice.split_words(texts[i]))
    model = lattice.processor(path)
    pieces = lattice.weigh_pieces(path, np.zeros(model.get_piece_size()), 0)
    for _ in range(2):
        sums = {}
        for word, c in counts.items():
            lattice.count_pieces(word, pieces, c, sums)
        mass = np.zeros(model.get_piece_size())
        for piece, n in sums.items():
            mass[model.piece_to_id(piece)] += n
        pieces = lattice.weigh_pieces(path, mass, len(learned))
    assert math.isclose(lattice.word_log_prob("nation", pieces), all_segmentations("nation", pieces), rel_tol=1e-9)
    for r in QUERIES["op8_lattice"](spark, sf).collect():
        words = [w.decode() for w in lattice.split_words(texts[r.doc_id])]
        want = (sum(lattice.word_log_prob(w, pieces) for w in words) + pieces.end) / math.log(10)
        assert math.isclose(r.score, want, rel_tol=1e-6)
        assert math.isfinite(r.mixture_score)
