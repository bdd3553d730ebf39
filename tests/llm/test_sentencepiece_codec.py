import hashlib
import random

import public_tokenizers
import sentencepiece

from stonefold.llm.sentencepiece_codec import codec, encode_decode, packed, unpacked

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "  a  b", "\n\n a\tb ", "▁x", "<s>hi</s>", "\0é字𝒳", "a​b  ", "   ", " ", "\n", "a\n b\n\nc", "\r\n x<0x0A>", "éé 🙂🙂́ x", "w" * 3000, "The cat sat. " * 4000]


def test_agenda_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    many = TEXTS + ["".join(rng.choices("  abcdeéßñ▁\n\t.,字🙂ABC", k=rng.randrange(60))) for _ in range(500)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate([None, *many])], "doc_id long, text string, pieces string").repartition(3)
    rows = {r.doc_id: r for r in encode_decode(df, PATH).collect()}
    for i, text in enumerate([None, *many]):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert unpacked(bytes(rows[i].ids)) == want, text
        assert rows[i].decoded == library.decode(want), text
        assert rows[i].pieces == "kept"


def test_decode_of_any_ids():
    own, rng = codec(PATH), random.Random(1)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == own.library.decode(ids), ids


def test_ids_are_little_endian():
    assert packed([1, 258]) == b"\x01\0\0\0\x02\x01\0\0" and hashlib.sha256(packed([])).hexdigest()[:4] == "e3b0"


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "text string, ids2 int"), PATH).collect() == []
