"""Plain zip members by their headers: what the standard library reads and writes, errors included."""

import io
import random
import warnings
import zipfile

import pytest

from scrivane.plans import office_queries
from scrivane.sources import members, office


def outcome(read):
    try:
        return "ok", read()
    except Exception as e:  # noqa: BLE001
        return type(e).__name__, str(e)


def contents(z):
    return [(i.filename, i.file_size, i.external_attr, i.is_dir(), outcome(lambda i=i: z.read(i)), outcome(lambda i=i: z.read(i.filename))) for i in z.infolist()]


def test_members_are_those_of_the_library_however_damaged():
    random.seed(3)
    plain = 0
    for k in range(1500):
        out = io.BytesIO()
        with warnings.catch_warnings(), zipfile.ZipFile(out, "w", random.choice([0, 8])) as z:
            warnings.simplefilter("ignore")  # names that repeat
            for _ in range(random.randint(0, 4)):
                z.writestr(random.choice(["a", "b/c.xml", "é", "d/", "a"]), random.choice([b"", b"abc" * 40, random.randbytes(20)]), random.choice([0, 8, 8, 12]))
        data = bytearray(out.getvalue())
        if k % 2:
            data[random.randrange(len(data))] = random.randrange(256)
        data = bytes(data) if k % 7 else b"junk" + bytes(data)
        found = members.plain_zip(data)
        plain += found is not None
        assert found is None or contents(found) == contents(zipfile.ZipFile(io.BytesIO(data)))
    assert plain > 300


@pytest.mark.parametrize("parts", [{}, {"a": "x", "b/c": b"\0\1"}, {"é": "x"}, {"d/": ""}, {"a": "", "b": "é" * 300}])
def test_zips_are_written_as_the_library_writes_them(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    assert office.zipped(parts) == out.getvalue()


def test_workbooks_need_no_file_objects(monkeypatch):
    """Objects of the library for each archive and member, and the same parts parsed for every file, were most of a workbook's time."""
    monkeypatch.setattr(zipfile, "ZipFile", lambda *a, **k: pytest.fail("a file object was built"))
    files = [office_queries.sheet_file("Orders", str(35_000 + i), str(i % 2), "1-URGENT") for i in range(3)]
    parsed, read = [], office._xml
    monkeypatch.setattr(office, "_xml", lambda data: parsed.append(data) or read(data))
    texts = [office.convert("xlsx", f) for f in files]
    assert texts[1] == "## Orders\n\n| 1995-10-29 00:00:00 | True | 1-URGENT | 35001 |\n| --- | --- | --- | --- |"
    assert len(parsed) <= 4 + len(files)


def test_kept_parts_do_not_mix():
    for word in ("a", "b", "a"):
        for serial, date in (("1", "1900-01-01"), ("36526", "2000-01-01")):
            assert office.convert("xlsx", office_queries.sheet_file(f"S{word}", serial, "0", word)) == f"## S{word}\n\n| {date} 00:00:00 | False | {word} | {serial} |\n| --- | --- | --- | --- |"
