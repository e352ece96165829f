"""The transducer on unigram models, whose pieces and scores are written here, against the library."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as formats

from folioscope.llm import sentencepiece_fst

WORDS = ["the", "ther", "her", "here", "he", "th", "ing", "in", "ings", "s", "a", "ab", "aba", "bab", "ba", "é", "éa", "日本", "本"]


def model(path, byte_fallback, scores, normaliser="identity"):
    m = formats.ModelProto()
    kinds = formats.ModelProto.SentencePiece
    m.trainer_spec.model_type = formats.TrainerSpec.UNIGRAM
    m.trainer_spec.byte_fallback = byte_fallback
    m.normalizer_spec.name = normaliser
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = True
    for piece, kind in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL)):
        m.pieces.add(piece=piece, score=0.0, type=kind)
    if byte_fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=kinds.BYTE)
    for piece, score in scores.items():
        m.pieces.add(piece=piece, score=score, type=kinds.NORMAL)
    m.trainer_spec.vocab_size = len(m.pieces)
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("kind", ["random", "ties", "tenths"])
def test_unigram(tmp_path, byte_fallback, kind):
    rng = random.Random(kind)
    pieces = dict.fromkeys(["▁", *"abehinrstg", *WORDS, *("▁" + w for w in WORDS), "%", "%%"])
    # tenths add up differently in single and double precision
    draw = {"random": lambda: -rng.random() * 9, "ties": lambda: -float(rng.randint(1, 3)), "tenths": lambda: -rng.randint(1, 40) / 10}[kind]
    path = model(tmp_path / "m.model", byte_fallback, {p: draw() for p in pieces})
    library, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    texts = ["", " ", "  the  here ", "%%%", "日本日", "xyz", "the x日 there", "a" * 300, "▁ a", "\n", "😀 a😀😀"]
    texts += ["".join(rng.choice(["the", "here", "ab", "a", "b", " ", "é", "ing", "s", "%", "x", "本"]) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    found = fst.encode(texts)
    differing = [(t, library.encode(t), ids) for t, ids in zip(texts, found) if library.encode(t) != ids]
    # paths of equal weight may be told apart by the order in which the library meets them: none may be lighter
    score = lambda ids: sum(0.0 if i in fst.bytes_of or i == fst.unknown else fst.scores[fst.pieces[i]] for i in ids)
    assert all(abs(score(a) - score(b)) < 1e-5 for _, a, b in differing) and not differing, differing[:5]
    for text, ids in zip(texts, found):
        assert fst.decode(ids) == library.decode(ids), text


def test_refused_models(tmp_path):
    path = model(tmp_path / "m.model", False, {"a": -1.0})
    m = formats.ModelProto.FromString(open(path, "rb").read())
    m.trainer_spec.model_type = formats.TrainerSpec.WORD
    (tmp_path / "w.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="only unigram"):
        sentencepiece_fst.Transducer(str(tmp_path / "w.model"))
    m.trainer_spec.model_type = formats.TrainerSpec.UNIGRAM
    m.pieces.add(piece="own", score=0.0, type=formats.ModelProto.SentencePiece.USER_DEFINED)
    (tmp_path / "u.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="defined by the user"):
        sentencepiece_fst.Transducer(str(tmp_path / "u.model"))


def test_merge_model_with_few_junctions_kept(monkeypatch):
    """Ids and decoded texts of the merge model are the same however few junctions are kept, and those known are counted."""
    from folioscope.llm import sentencepiece_fst
    from folioscope.llm.queries import tokenizer_path

    texts = ["Hello  world, the quick brown fox", "", " lead and trail ", "naïve 日本語 text\twith\ntabs ▁ 😀😀", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    wanted = sentencepiece_fst.Transducer(tokenizer_path("piece_bpe_32k.model")).encode(texts)
    monkeypatch.setattr(sentencepiece_fst, "CACHED", 3)
    fst = sentencepiece_fst.Transducer(tokenizer_path("piece_bpe_32k.model"))
    assert [fst.encode([t])[0] for t in texts] == wanted
    assert sum(map(len, fst.junctions.values())) == fst.known <= 4
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert wanted == peer.encode(texts) and [fst.decode(i) for i in wanted] == peer.decode(wanted)
