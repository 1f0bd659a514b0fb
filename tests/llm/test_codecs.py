"""Operators 2, 8, 9 and 10 against the libraries and plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import licenses, pii, sentencepiece_codec, token_store
from loomgraph.llm.shared import shared_path

TEXTS = ["", None, "a", " ", "  two  blanks ", "a\tb\n\n c", "naïve café\nx", "▁odd ▁mark", "long " * 3000 + "w" * 5000, "same", "same", "it's  we're\r\nend \n", "<|endoftext|> <s>", "日本 語　全角", "😀 😀x\x00", "a ", "\n", "x​ y\x1c z"]


def frame(spark, texts):
    rows = [(None if k == 3 else k // 2 * 7, t, "x", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score int")


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    model = sentencepiece_codec.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sorted(map(tuple, sentencepiece_codec.codec_digests(frame(spark, TEXTS), model).collect()), key=str)
    want = []
    for k, t in enumerate(TEXTS):
        ids = [1, *sp.encode(t or ""), 2]
        want.append((None if k == 3 else k // 2 * 7, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    rows = sentencepiece_codec.encode_documents(frame(spark, TEXTS[:3]), model).collect()
    assert [r.ids for r in rows] == [[1, 2], [1, 2], [1, *sp.encode("a"), 2]]
    assert sentencepiece_codec.codec_digests(frame(spark, []), model).count() == 0


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = token_store.default_tokenizer()
    t = Tokenizer.from_file(path)
    files = token_store.write_token_files(frame(spark, TEXTS), path, shared_path(spark, "t"))
    got = token_store.read_token_files(spark, files).orderBy("start").collect()
    want = Counter()
    for k, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[None if k == 3 else k // 2 * 7, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    some = [b for p, _, _ in files for d, b in token_store.SeekableReader(p).documents({7})]
    assert len(some) == 1 and len(some[0]) % 4 == 0  # the other row of this id has none
    assert token_store.read_token_files(spark, token_store.write_token_files(frame(spark, []), path, shared_path(spark, "t"))).count() == 0


def test_token_files_are_of_bounded_size(spark, monkeypatch):
    """A hot doc_id in many files, each of few documents, read in slices."""
    path = token_store.default_tokenizer()
    docs = spark.createDataFrame([(7 if k % 3 else k, f"text number {k}") for k in range(400)], "doc_id long, text string")
    monkeypatch.setattr(token_store, "FILE_DOCS", 30)
    monkeypatch.setattr(token_store, "READ_DOCS", 7)
    files = token_store.write_token_files(docs, path, shared_path(spark, "t"))
    assert max(n for _, n, _ in files) <= 30 and sum(n for _, n, _ in files) == 400
    got = token_store.read_token_files(spark, files).orderBy("start").collect()
    assert len(got) == 400 and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_token_files_split_frames_and_checksum(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_IDS", 10)
    w = token_store.SeekableWriter(str(tmp_path / "a.ids.zst"))
    long, short = np.arange(25, dtype="<u4").tobytes(), np.arange(3, dtype="<u4").tobytes()
    w.add(5, long)
    w.add(None, short)
    w.close()
    r = token_store.SeekableReader(w.path)
    assert len(r.entries) == 4 and dict(r.documents()) == {5: long, None: short}
    raw = bytearray((tmp_path / "a.ids.zst").read_bytes())
    r.entries = r.entries.copy()
    r.entries[0, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        r.read(0)
    assert raw[-4:] == token_store.SEEKABLE_MAGIC.to_bytes(4, "little")


def plain_base(text):
    """The contract's patterns, applied as they stand."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_patterns():
    import random

    r = random.Random(1)
    for alphabet in ("ab@.-+ é1", "0123456789 -.+()", "1.2.3 @a"):
        for _ in range(3000):
            t = "".join(r.choices(alphabet, k=r.randint(0, 60)))
            assert pii.base_spans(t) == plain_base(t), t
    t = "x 4111 1111 1111 1111 y +1 (977) 555-9722 a@b.c 1.2.3.4 256.1.1.1 a@b.c@d.e.f"
    assert pii.base_spans(t) == plain_base(t)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write jo.doe [at] mail [dot] example [dot] com now", "email", "jo.doe [at] mail [dot] example [dot] com"),
        ("write jo(at)mail.example.com now", "email", "jo(at)mail.example.com"),
        ("write jo at mail dot example dot com now", "email", "jo at mail dot example dot com"),
        ("écrire jo＠mail．example．com ici", "email", "jo＠mail．example．com"),
        ("mail jо@mаil.com x", "email", "jо@mаil.com"),
        ("call +1 nine seven seven five five five nine seven two two now", "phone", "+1 nine seven seven five five five nine seven two two"),
        ("call plus one nine seven seven five five five nine seven two two now", "phone", "plus one nine seven seven five five five nine seven two two"),
        ("ip １９２.168.0.1 x", "ip", "１９２.168.0.1"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("card ４１１１ 1111 1111 1111 end", "card", "４１１１ 1111 1111 1111"),
        ("write john one two [at] example [dot] com now", "email", "john one two [at] example [dot] com"),
        ("write john one two at mail dot example dot com now", "email", "john one two at mail dot example dot com"),
        ("write jоhn one two [at] example [dot] com now", "email", "jоhn one two [at] example [dot] com"),
        ("card four one one one １１１１ 1111 one one one one end", "card", "four one one one １１１１ 1111 one one one one"),
        ("host one nine two dot one six eight dot ０ dot one up", "ip", "one nine two dot one six eight dot ０ dot one"),
    ],
)
def test_disguises_map_back(text, kind, part):
    base, both = pii.find_spans(text)
    spans = [text[a:b] for a, b, k in both if k == kind and (a, b, k) not in base]
    assert part in spans
    assert set(base) <= set(both)
    assert part not in pii.redact(text, both)


LONG = {
    "digits": ("7", 1, ""), "name": ("a", 1, "@b"), "dots": ("1.", 2, ""), "brackets": ("(", 1, " one two"), "blanks": (" ", 1, "7"), "spelled": ("one ", 4, ""), "ats": ("a@", 2, ""),
    "disguises": ("one two [at] ", 13, ""), "labels": ("a.", 2, ""), "dashes": ("1-", 2, ""), "wide": ("１", 1, ""),
}


def cpu_ratio(run, small, large):
    """CPU time of the large input against that of the small one, the best of three each: machines differ, growth does not."""
    import time

    def took(x):
        times = []
        for _ in range(3):
            began = time.process_time()
            run(x)
            times.append(time.process_time() - began)
        return max(min(times), 1e-3)

    run(small)
    return took(large) / took(small)


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_linear_time(name):
    part, size, end = LONG[name]
    start = {"labels": "x at a.", "blanks": "+1 "}.get(name, "")
    text = lambda n: start + part * (n // size) + end
    base, both = pii.find_spans(text(20_000))
    assert set(base) <= set(both)
    assert cpu_ratio(pii.find_spans, text(20_000), text(160_000)) < 24  # 8 if linear, 64 if quadratic


def test_many_spans_take_linear_time():
    text = "a@b.cd or e [at] f [dot] gh, "
    base, both = pii.find_spans(text * 1000)
    assert len(base) == 1000 and len(both) == 2000
    assert cpu_ratio(pii.find_spans, text * 1000, text * 8000) < 24


def test_ordinary_prose_is_left_alone():
    for t in ("we met at the store. Then one, two or three left", "look at it at home.Then go", "point by point", "seven of nine at 5.30"):
        assert pii.find_spans(t) == ([], [])


def test_pii_frames(spark):
    docs = frame(spark, [None, "", "a@b.cd", "a@b.cd", "x" * 200_000 + " a@b.cd"])
    rows = pii.detect(docs).collect()
    assert [(r.n_email, r.spans) for r in rows] == [(0, ""), (0, ""), (1, "email:0:6"), (1, "email:0:6"), (1, "email:200001:200007")]
    assert rows[2].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    clean = pii.redact_column(docs)
    assert clean.columns == docs.columns and [r.text for r in clean.collect()][:3] == [None, "", "[EMAIL]"]
    assert pii.detect(frame(spark, [])).count() == 0


def license_findings(spark, texts, known=None):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, digest string, unit int")
    rows = licenses.scan(docs, licenses.known_digests(spark) if known is None else known).collect()
    return sorted((r.doc_id, r.kind, r.unit, r.license_id) for r in rows)


def test_licenses(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses._MIT.replace("sublicense", "sub-license").upper()
    texts = [None, "", mit, "x\nReleased under the MIT Licence!\n\ny", "Licensed under CC BY-NC 4.0", "released", "# x\n#\n# " + licenses._ISC.replace("\n\n", "\n#\n# ") + "\n\nimport os", "...\n\n", mit + "\n\n" + licenses._ZLIB]
    want = [(2, "text", 0, "MIT"), (3, "line", 2, "MIT"), (4, "text", 0, "CC-BY-NC-4.0"), (6, "block", 2, "ISC"), (8, "block", 1, "MIT"), (8, "block", 4, "Zlib")]
    assert license_findings(spark, texts) == want
    assert license_findings(spark, texts, licenses.known_digests(spark, [], [])) == []
    assert licenses.scan(frame(spark, []), licenses.known_digests(spark)).count() == 0


def wrapped(text, width):
    import textwrap

    return "\n\n".join(p if "Copyright (C)" in p else "\n".join(textwrap.wrap(p, width)) for p in re.split(r"\n\s*\n", text))


def test_licenses_of_any_line_width(spark):
    full = {"MIT": licenses._MIT, "ISC": licenses._ISC, "BSD-3-Clause": licenses._BSD_HEAD + licenses._BSD_THIRD + licenses._BSD_TAIL, "Unlicense": licenses._UNLICENSE, "BSL-1.0": licenses._BOOST, "GPL-3.0-or-later": licenses._GPL_NOTICE}
    cases = [(i, "Copyright (c) 2020 A. Author\nAll rights reserved.\n\n" + wrapped(t, width)) for i, t in full.items() for width in range(40, 121)]
    got = license_findings(spark, [t for _, t in cases])
    assert got == [(k, "text", 0, i) for k, (i, _) in enumerate(cases)]


@pytest.mark.skipif(not __import__("os").path.isfile("/usr/share/common-licenses/Apache-2.0"), reason="no licence texts on this machine")
def test_whole_licenses_by_digest(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    cases = []
    for f, i in files.items():
        with open(f"/usr/share/common-licenses/{f}", encoding="utf-8") as file:
            t = file.read()
        cases += [(i, "text", t), (i, "text", wrapped(t, 60).upper()), (i, "block", "A preface.\n\n" + t + "\n\nAnd more.")]
    found = license_findings(spark, [t for *_, t in cases])
    for k, (i, kind, _) in enumerate(cases):
        assert (k, kind, 0 if kind == "text" else 2, i) in found, (k, i, kind)


def test_license_oracle_equals_scan(spark, tmp_path):
    import duckdb

    texts = ["", "x\n\nReleased under the MIT Licence!\n\ny", "a\n\n" + wrapped(licenses._MIT, 50) + "\n\nb", "SPDX-License-Identifier: MIT", "Copyright 2020 x\n(c) 2021 y\n" + licenses._ISC, "© z\n" + licenses._ZLIB.replace("\n", "\r\n"), "all rights reserved.\n" + licenses._UNLICENSE]
    spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, kind, unit, license_id FROM ({licenses.oracle()})").fetchall())
    assert len(want) >= 6
    assert sorted((r.doc_id, r.kind, r.unit, r.license_id) for r in licenses.op9_licenses(spark, str(tmp_path)).collect()) == want
