"""The parts that work on arrays and bytes, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievelake.llm import gif, idcoder, near_dups, tools
from sievelake.llm.repeats import pack_cells, unpack_cells
from sievelake.llm.secrets import base_spans, candidates
from sievelake.llm.tokens import Encoder
from sievelake.llm.words import gram_hashes, pieces, text_bytes, words_of

from .brute import secrets

LETTERS = ["a", " ", "\n", "é", "'s", "'", " b", "\xa0", "\t", ".", "É", "1", "×", "<|endoftext|>", "Ω", "é", "  ", "ſ", "K", "İ", "日", "​", "!?", "\x1c", "ing", "the", "\r\n", "_", "-"]


def texts(n, seed, letters=LETTERS, most=30):
    dice = random.Random(seed)
    return ["".join(dice.choices(letters, k=dice.randint(0, most))) for _ in range(n)]


def test_words_and_runs():
    rows = [*texts(300, 1), "", "tail"]
    words = words_of(*text_bytes(pa.array(rows)))
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in rows]
    assert np.diff(words.of_doc).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end)] == flat
    names = {}
    assert all(names.setdefault(h, w) == w for h, w in zip(words.hash.tolist(), flat)) and len(names) == len(set(flat))
    runs, first = gram_hashes(words, 3)
    want = [tuple(p[i : i + 3]) for p in plain for i in range(len(p) - 2)]
    names = {}
    assert all(names.setdefault(h, w) == w for h, w in zip(runs.tolist(), want, strict=True)) and len(names) == len(set(want))


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * k for k in range(50)] + [None]), pa.array(range(51))], names=["text", "k"])
    parts = list(pieces(iter([batch, batch.slice(0, 0)]), "text", 100))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(51)) and len(parts) > 10


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_librarys(name):
    path = public_tokenizers.path(name)
    own, library = Encoder(path, most=200), Tokenizer.from_file(path)
    rows = texts(1500, 2) + texts(300, 3, [c for c in LETTERS if c.isascii() and c != "<|endoftext|>"]) + ["", "Übergrößen, ÀÉÎ. día!"]
    for k in range(0, len(rows), 100):
        part = rows[k : k + 100]
        ids, at = own.encode([t.encode() for t in part])
        for j, t in enumerate(part):
            assert ids[at[j] : at[j + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_library_is_asked_once_for_a_word(name):
    """Marks are cut off by their bytes, so a word with other marks behind it is not a new word."""
    path = public_tokenizers.path(name)
    own, library = Encoder(path), Tokenizer.from_file(path)
    rows = [f"Straße{a} über{b}\nabc{a}{b} it's{a} 3.5{b} x.{a}y" for a in ("", "%%%", "$$$", "...###", '"') for b in ("", ")", ",&&&", "***")]
    asked = []
    whole, own._whole = own._whole, lambda text: asked.append(text) or whole(text)
    learn, own._learn = own._learn, lambda words: asked.extend(words) or learn(words)
    data = "".join(rows).encode()
    ids, at = own.encode_bytes(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(r.encode()) for r in rows]))
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(rows))] == [library.encode(r, add_special_tokens=False).ids for r in rows]
    assert not any("Stra" in w for w in asked if isinstance(w, str)) and [w for w in asked if isinstance(w, bytes) and b"Stra" in w] == ["Straße".encode()]
    more = len(asked)
    own.encode(["".join(rows[:1]).encode()])
    assert len(asked) == more


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=60), st.integers(1, 40), st.integers(1, 9))
def test_coded_ids_come_back(ids, times, block):
    ids = np.array(ids * times, np.int64)
    assert (idcoder.decode_ids(idcoder.encode_ids(ids, block * 7)) == ids).all()


def test_symbols_are_found_by_their_borders():
    """Four borders are compared at once; every symbol keeps a span, however one-sided the counts."""
    dice = np.random.default_rng(4)
    model = idcoder.Model(50, searched=True)
    model.met[:] = dice.integers(0, 40, len(model.met)) ** dice.integers(0, 3, len(model.met)) * idcoder.STEP
    model.met[: model.stride : 3] = 2048 * idcoder.STEP
    model.renew()
    cum = model.cum.astype(int)
    assert (cum[0] == 0).all() and (cum[-1] == 1 << idcoder.TOTAL_BITS).all() and (np.diff(cum, axis=0) > 0).all()
    model.predict(50)
    for row in dice.permutation(model.stride)[:400].reshape(8, 50):
        model.row = row
        for value in [*dice.integers(0, 4096, (20, 50)), cum[3, row], cum[3, row] - 1, np.full(50, 4095), np.zeros(50, int)]:
            assert model.search(value.astype(np.uint64)).tolist() == [int((cum[1:, r] <= v).sum()) for r, v in zip(row, value, strict=True)]


def test_coder_learns_and_checks():
    ids = np.tile(np.random.default_rng(1).integers(0, 49000, 50), 400)
    data = idcoder.encode_ids(ids)
    assert len(data) < len(ids) // 2
    for at in (0, 9, 25, 60, len(data) // 2):
        with pytest.raises(ValueError):
            idcoder.decode_ids(data[:at] + bytes([data[at] ^ 85]) + data[at + 1 :])
    for cut in (data[:3], data[:30], data[:-2]):
        with pytest.raises(ValueError):
            idcoder.decode_ids(cut)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 60))
def test_lzw_round_trip(data, times):
    data = data * times
    assert gif.lzw_samples(gif.pack_codes(*gif.lzw_codes(data)), 8) == data


def test_lzw_full_table():
    data = np.random.default_rng(3).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_samples(gif.pack_codes(*gif.lzw_codes(data)), 8) == data


def frame(samples, left, top, width, height, size=2, delay=5, disposal=0, transparent=None, flags=0, palette=b""):
    control = b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None), delay, 0, transparent or 0]) + b"\0"
    head = b"\x2c" + b"".join(int(x).to_bytes(2, "little") for x in (left, top, width, height)) + bytes([flags])
    return control + head + palette + bytes([size]) + gif.blocks(gif.pack_codes(*gif.lzw_codes(bytes(samples), size), size))


def test_gif_rules():
    red, green, blue, white = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
    table = bytes([*red, *green, *blue, *white])
    data = b"GIF89a\x02\0\x02\0\xf1\0\0" + table + b"\x21\xfe\x03abc\0"
    data += frame([0, 1, 2, 3], 0, 0, 2, 2, disposal=1)
    data += frame([3, 0], 0, 0, 2, 1, disposal=2, transparent=0)
    data += frame([1], 1, 1, 1, 1, disposal=3, delay=7)
    data += frame([0, 0], 0, 1, 2, 1, flags=0x80, palette=bytes([*white, *red]))
    shown = list(gif.decode_gif(data + b"\x3b"))
    assert [f.delay_ms for f in shown] == [50, 50, 70, 50]
    assert shown[0].canvas.tolist() == [[[*red], [*green]], [[*blue], [*white]]]
    assert shown[1].canvas.tolist() == [[[*white], [*green]], [[*blue], [*white]]]  # index 0 is transparent
    assert shown[2].canvas.tolist() == [[[0, 0, 0], [0, 0, 0]], [[*blue], [*green]]]  # the area was cleared
    assert shown[3].canvas.tolist() == [[[0, 0, 0], [0, 0, 0]], [[*white], [*white]]]  # put back, then the own palette
    for cut in (b"", b"GIF89", data[:20], data + b"\x99", b"PNG" + data):
        with pytest.raises(ValueError):
            list(gif.decode_gif(cut))


def test_gif_interlace():
    rows = list(range(10))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    data = b"GIF89a\x01\0\x0a\0\xf3\0\0" + bytes(x for k in range(16) for x in (k, k, k)) + frame([rows[k] for k in order], 0, 0, 1, 10, size=4, flags=0x40)
    assert next(gif.decode_gif(data + b"\x3b")).canvas[:, 0, 0].tolist() == rows


def test_cells_round_trip():
    for seed in range(20):
        cells = np.unique(np.random.default_rng(seed).integers(0, 1 << 20, 10**seed if seed < 5 else seed))
        assert (unpack_cells(pack_cells(cells)) == cells).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    factors = near_dups.seeds(21, near_dups.HASHES) | np.uint64(1)
    for share in (0.5, 0.8, 0.95):
        found = []
        for _ in range(60):
            pool = rng.integers(0, 2**64, 700, dtype=np.uint64)
            both = int(350 * share * 2 / (1 + share))
            one, two = pool[:350], np.concatenate([pool[:both], pool[350 : 700 - both]])
            found.append(np.mean([(one * f).min() >> np.uint64(32) == (two * f).min() >> np.uint64(32) for f in factors]))
        assert abs(np.mean(found) - share) < 0.03


def test_pruning_keeps_similar_pairs():
    least = near_dups.least_matches(80)
    assert least == sorted(least) and least[-1] < 0.8 * near_dups.HASHES
    rng = np.random.default_rng(7)
    matches = (rng.random((200_000, near_dups.HASHES)) < 0.8).reshape(-1, 4, near_dups.BATCH).sum(2).cumsum(1)
    assert (matches >= np.array(least)).all()


def test_secret_spans():
    rows = texts(400, 9, ["token", "=", ":", " ", '"', "password", "secret", "api_key", "APIKEY", "abcdefgh", "0123abcd" * 4, "AKIA", "ABCDEFGHIJKLMN", "é", "\n", "/", "x1Y2z3W4" * 3, ",", "f" * 31], 14)
    for t in rows:
        base = base_spans(t)
        assert ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b, _ in base) == secrets(t)[4], repr(t)
        for start, _, end, _ in candidates(t, base):
            assert not any(a <= start and end <= b for a, _, b, _ in base)
    assert [c[3] for c in candidates("key x1Y2z3W4q5R6s7T8u9V0 donaudampfschifffahrtsgesellschaft", [])] == ["x1Y2z3W4q5R6s7T8u9V0"]


@pytest.mark.parametrize(
    "value, text",
    [(1.0, "1"), (0.0, "0"), (-0.0, "0"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1.5e-7, "1.5e-7"), (0.000001, "0.000001"), (0.00001234, "0.00001234"), (-2.5, "-2.5"), (123456.789, "123456.789"), (5e-324, "5e-324"), (1e-7, "1e-7")],
)
def test_numbers(value, text):
    assert tools.number_text(value) == text


def test_canonical_json():
    assert tools.canonical(tools.parse(' {"b": [1, 2.0, null, true], "a": "\\u00e9\\n", "\\ud83d\\ude00": 1, "\\ufb33": 2} ')) == '{"a":"é\\n","b":[1,2,null,true],"😀":1,"דּ":2}'
    for bad in ("", "{", "NaN", "[1e999]", "[" * 100_000):
        with pytest.raises(ValueError):
            tools.parse(bad)


def test_schema_problems():
    schema = tools.parse('{"type":"object","required":["q"],"properties":{"q":{"type":"string","minLength":2,"pattern":"^a"},"n":{"type":["integer","null"],"minimum":1,"maximum":5},"t":{"type":"array","maxItems":1,"items":{"enum":["x",1]}}},"additionalProperties":false}')
    assert tools.problems({"q": "ab", "n": None, "t": ["x"]}, schema) == []
    assert tools.problems({"q": "ab", "n": 3.0, "t": [1.0]}, schema) == []
    assert tools.problems({"n": 9, "z": 1, "t": ["y", "x"]}, schema) == ["$.q: missing", "$.n: maximum", "$.t: maxItems", "$.t[0]: not in enum", "$.z: not allowed"]
    assert tools.problems({"q": "b", "n": True}, schema) == ["$.n: expected integer or null", "$.q: minLength", "$.q: pattern"]
    assert tools.problems([], schema) == ["$: expected object"]
    assert tools.judge("f", "{}", "nonsense") == ("{}", ["schema: not JSON"])
    assert tools.judge("f", None, None) == (None, ["$: not JSON"])


@pytest.mark.parametrize(
    "arguments, schema, shown, found",
    [
        (r'{"q":"\ud800"}', '{"properties":{"q":{"maxLength":0}}}', r'{"q":"\ud800"}', ["$.q: maxLength"]),
        (r'{"\udc00":1}', '{"additionalProperties":false}', r'{"\udc00":1}', [r"$.\udc00: not allowed"]),
        ("[" * 5000 + "]" * 5000, "{}", None, ["$: not JSON"]),
        ("[" * 200 + "]" * 200, "{}", "[" * 200 + "]" * 200, []),
        ("{}", "[" * 5000 + "]" * 5000, "{}", ["schema: not JSON"]),
        ("1" * 5000, "{}", None, ["$: not JSON"]),
        ('{"q":"x"}', '{"properties":{"q":{"pattern":"("}}}', '{"q":"x"}', ["schema: PatternError"]),
        ("1", '{"minimum":"x"}', "1", ["schema: TypeError"]),
        ("1", '{"enum":5}', "1", ["schema: TypeError"]),
        ('"a"', '{"maxLength":null}', '"a"', ["schema: TypeError"]),
        ("1", '{"type":{}}', "1", []),
        ("1", '{"type":[{}]}', "1", ["schema: TypeError"]),
        ("1", '{"exclusiveMinimum":5}', "1", ["$: exclusiveMinimum"]),
        ("7", '{"multipleOf":2,"exclusiveMaximum":7}', "7", ["$: exclusiveMaximum", "$: multipleOf"]),
        ("[1,1.0]", '{"uniqueItems":true}', "[1,1]", ["$: uniqueItems"]),
        ("{}", '{"minProperties":1}', "{}", ["$: minProperties"]),
        ("1", '{"$ref":"#/x"}', "1", ["$: schema has $ref, which is not supported"]),
        ("1", '{"anyOf":[{"type":"string"},{"minimum":2}]}', "1", ["$: anyOf"]),
        ("3", '{"oneOf":[{"type":"integer"},{"minimum":2}],"not":{"const":3}}', "3", ["$: oneOf", "$: not"]),
        ("3", '{"allOf":[{"type":"integer"},{"minimum":2}],"title":"t"}', "3", []),
    ],
)
def test_odd_arguments_and_schemas(arguments, schema, shown, found):
    """One odd row gets an answer of its own; it never ends the batch, and what comes out is UTF-8."""
    text, wrong = tools.judge("f", arguments, schema)
    assert (text, wrong) == (shown, found)
    "".join([text or "", *wrong]).encode()
