"""The encoder by pieces against the tokenizer on whole texts."""

import json
import random

import pyarrow as pa
import pytest

from firnline.llm import tokenbin

ODD = ["Don't stop'start 's \"'s x'll", "a<|endoftext|>b", "<|startoftext|>", "ÀÉÎ×÷ßÿ Ÿ", "é  x y", "Å Σας ΣΑΣ", "12ab34 ٣٤ a1'b", "\x00\x01 \x7f\x85a", "日本語 text 中文。", "ﬁ İi ǅ", "ªº µ ¿qué? ¡hola!", "", "   \n\n\t x\ty", "😀😀 a😀b", "O'Neill's", "--..'t", "c'est l'été", None, "a" * 3000, "ĺ é Éx", "UPPER ÉÉ é1é", "x" + "\xa0" + "y"]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def ids_of(encoder, texts):
    out = []
    for ids, cuts in encoder.encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def test_pieces_give_the_same_ids(path):
    rng = random.Random(3)
    signs = "abcdeéñßÀÖ'.,<|>-09 \n\t漢İ"
    texts = [*ODD, *("".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(300))]
    assert ids_of(tokenbin.WordEncoder(path), texts) == ids_of(tokenbin.Encoder(path), texts)
    assert ids_of(tokenbin.WordEncoder(path), []) == ids_of(tokenbin.WordEncoder(path), [None][:0]) == []


def test_texts_over_a_block_and_a_forgetful_cache(path, monkeypatch):
    monkeypatch.setattr(tokenbin, "CACHE_PIECES", 50)
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("aeioustnrlé") for _ in range(rng.randint(2, 8))) for _ in range(400_000))
    texts = [None, long, "", *[long[i : i + 900] for i in range(0, 90_000, 900)]]
    assert len(long.encode()) > 2 * tokenbin.BLOCK_BYTES
    model = tokenbin.WordEncoder(path)
    assert ids_of(model, texts) == ids_of(tokenbin.Encoder(path), texts)
    assert len(model.old) > 0


def test_other_settings_encode_whole_texts(path, tmp_path):
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    assert tokenbin.WordEncoder.fits(path)
    settings["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(settings))
    assert type(tokenbin.encoder_of(str(tmp_path / "t.json"))) is tokenbin.Encoder
    assert ids_of(tokenbin.encoder_of(str(tmp_path / "t.json")), [None, "", "two words"])[:2] == [[], []]
