import io
import os
import zipfile

import pytest

from tessera.engine import Engine
from tessera.sources import extract as X

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book() -> bytes:
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData><row><c t="s"><v>0</v></c><c><v> </v></c><c t="s"><v>1</v></c></row><row/><row><c t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c><c><f>A1</f><v>2.5</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_formats():
    assert X.extract("a.xlsx", book()) == "# Sheet: One\nhead\trich\nTrue\tin\t2.5"
    assert X.extract("a.xlsx", b"broken") == "" and X.extract("a.pdf", b"%PDF") is None and X.extract("a.bin", b"x") == ""
    assert X.extract("a.csv", b"a, ,b\n,\nc") == "a\tb\nc" and X.extract("a.tsv", b"a\tb\n") == "a\tb" and X.extract("a.json", b'{"k":[1]}') == '{\n  "k": [\n    1\n  ]\n}' and X.extract("a.py", b"x = 1") == "x = 1"


def test_folder_to_search(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name, text in {"a.txt": "plain apples " * 300, "b.md": "pears and apples", "src/pyproject.toml": "[project]\n", "src/m.py": "import os\n\ndef go():\n    pass\n", "src/node_modules/z.txt": "apples"}.items():
        (tmp_path / name).write_text(text)
    e = Engine(spark)
    assert sorted((os.path.basename(r.path), r.action) for r in e.index_folder(str(tmp_path)).collect()) == [("a.txt", "insert"), ("b.md", "insert"), ("m.py", "insert"), ("pyproject.toml", "insert")]
    e.files = spark.createDataFrame(e.files.collect(), e.files.schema)
    os.remove(tmp_path / "b.md")
    assert sorted((os.path.basename(r.path), r.action) for r in e.index_folder(str(tmp_path)).collect() if r.action != "skip") == [("b.md", "purge")]
    hits = e.search("apples", top_k=0, chunks=9).collect()
    assert len(hits) == 1 and hits[0].path.endswith("a.txt")
    after = e.neighbours(hits[0].chunk_id, "next", 99).collect()
    first = hits[0].chunk_index
    assert [r.chunk_index for r in after] == list(range(first + 1, min(first + 6, after[0].chunk_total)))
    back = e.neighbours(after[0].chunk_id, "PREV ").first()
    assert back.chunk_id == hits[0].chunk_id
    with pytest.raises(ValueError):
        e.neighbours(hits[0].chunk_id, "up")
    with pytest.raises(LookupError):
        Engine(spark).neighbours(hits[0].chunk_id)
    index = e.code_index()
    assert [r.method for r in index["roots"].collect() if r.folder.endswith("src")] == ["manifest"]
    assert [(r.name, r.line) for r in index["symbols"].collect()] == [("go", 3)] and [r.imports for r in index["modules"].collect()] == [["os"]]
    assert {r.category: r.files for r in e.sources().collect()}["text"] >= 1
    path = [r.path for r in e.files.collect() if r.path.endswith("m.py")][0]
    assert e.lines(path, 3, 3).first().text == "def go():" and e.content([path, "/none"], 6).where("found").first().text == "import"
