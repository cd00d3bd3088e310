import hashlib

import pytest

from gridloom.llm import fill_middle as M

from .conftest import SCHEMA, odd_rows, rows_of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        form, a, b = M.layout(text, doc_id)
        p, m, s = text[:a], text[a:b], text[b:]
        whole = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        cut = (None, None) if form == "plain" else (a, b - a)
        out.append((doc_id, len(text), form, *cut, sha(whole), sha(text)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [1, 7, M.PIECE])
def test_equals_plain_assembly(odd, piece):
    assert rows_of(M.fill_in_middle(odd, piece)) == plain(odd_rows())


def test_all_forms_occur():
    assert {M.layout("some text here", i)[0] for i in range(200)} == {"plain", "psm", "spm"}


def test_marks_split_over_pieces_and_texts_that_end_like_marks(spark):
    texts = ["a<b<", "<", "<P", "x<P>y", "<S<S<S<M", "P>S>M>", "<<<<>>>>", "é😀<漢字<S"] * 30
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for piece in (1, 2, 3):
        got = rows_of(M.fill_in_middle(docs, piece))
        assert got == plain(rows)
        assert all(r[6] == sha(texts[r[0]]) for r in got)
    forms = {r[0]: r[2] for r in rows_of(M.fill_in_middle(docs))}
    assert all(forms[i] == "plain" for i, t in enumerate(texts) if "<P>" in t)


def test_stream_of_any_chunks_gives_the_parts():
    whole = "<S>suf<fix<P>pre<M<M>mid<P>".encode()  # marks of parts already read are text
    for size in (1, 2, 3, 50):
        reader, found = M.Parts("spm"), {}
        for i in range(0, len(whole), size):
            for part, place, data in reader.feed(whole[i:i + size]):
                assert place == len(found.get(part, b""))
                found[part] = found.get(part, b"") + data
        for part, _, data in reader.feed(b"", True):
            found[part] = found.get(part, b"") + data
        assert found == {2: b"suf<fix", 0: b"pre<M", 1: b"mid<P>"}


def test_output_table_holds_the_output_in_order(odd):
    pieces = M.output_table(odd, 100).collect()
    whole, heads = {}, {}
    for r in pieces:
        whole[r["key"]] = whole.get(r["key"], b"") + bytes(r["piece"])
        heads.setdefault(r["key"], r["doc_id"])
    want = sorted((repr(r[0]), r[5]) for r in plain(odd_rows()))
    assert sorted((repr(heads[k]), hashlib.sha256(v).hexdigest()) for k, v in whole.items()) == want


def test_empty_and_clashing(odd, empty, clashing):
    assert M.fill_in_middle(empty).count() == 0
    extra = clashing(odd).withColumnRenamed("label", "piece")
    assert rows_of(M.fill_in_middle(extra)) == rows_of(M.fill_in_middle(odd))
