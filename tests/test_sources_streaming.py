"""Readers/writers on temp files, and the streaming jobs."""

from __future__ import annotations

import json
import os

from conftest import SF_SMALL
from pyspark.sql import functions as F

from codelens.sources import fixtures as FX
from codelens.sources import io as IO
from codelens.sources.tables import read_table


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_csv_strings_multiline_and_leading_zeros(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.csv")
    _write(p, 'UEN,name,code\n001,"Acme\nPte, ""Ltd""",01111\n002,Beta,20000\n')
    rows = IO.read_csv_strings(spark, p).collect()
    assert rows[0]["name"] == 'Acme\nPte, "Ltd"' and rows[0]["code"] == "01111" and rows[0]["UEN"] == "001"
    typed = IO.read_csv_typed(spark, p, "UEN string, name string, code int", multi_line=True).collect()
    assert typed[0]["code"] == 1111  # what inference would do; strings keep the zero


def test_read_dictionary_drops_preamble(spark, tmp_dir):
    p = os.path.join(tmp_dir, "dict.csv")
    _write(p, "Title line,,,,,\n,,,,,\nsub,,,,,\n,,,,,\nSSIC 2020,Title,Groups,Def,Cross,Examples\n"
              'A,Section A,"•01 x\n•02 y",,,\n01111,Growing,,grow things,,<Blank>\n')
    rows = IO.read_dictionary(spark, p).collect()
    assert [r["code"] for r in rows] == ["A", "01111"]
    assert rows[1]["examples"] == "<Blank>" and rows[1]["definition"] == "grow things"


def test_read_index(spark, tmp_dir):
    p = os.path.join(tmp_dir, "idx.csv")
    _write(p, "x,,\n,,\nSSIC 2020,Desc,Other\n01111,farming,z\n01112,,z\n")
    rows = IO.read_index(spark, p).collect()
    assert [(r["code"], r["definition"]) for r in rows] == [("01111", "farming")]


def test_read_url_map(spark, tmp_dir):
    p = os.path.join(tmp_dir, "m.json")
    _write(p, json.dumps({"R1": ["a.com", "http://b.com", None]}) + "\n" + json.dumps({"R2": ["https://c.com", "a.com"]}) + "\n")
    rows = sorted(tuple(r) for r in IO.read_url_map(spark, p).collect())
    assert rows == [("R1", "https://a.com"), ("R1", "https://b.com"), ("R2", "https://a.com"), ("R2", "https://c.com")]


def test_list_report_files(spark, tmp_dir):
    for n in ["ACME PTE LTD 2023.pdf", "BETA.CORP 2022.pdf", "notes.txt"]:
        _write(os.path.join(tmp_dir, n), "%PDF")
    rows = sorted(r["company"] for r in IO.list_report_files(spark, tmp_dir).collect())
    assert rows == ["ACME PTE LTD", "BETA CORP"]


def test_cached_reference_refresh(spark, tmp_dir):
    p = os.path.join(tmp_dir, "ref.csv")
    _write(p, "a,b\n1,x\n")
    ref = IO.CachedReference(spark, p)
    assert ref.get().count() == 1
    _write(p, "a,b\n1,x\n2,y\n")
    assert ref.refresh().count() == 2


def test_write_result_bundle(spark, tmp_dir):
    t = FX.truth(spark, SF_SMALL)
    paths = IO.write_result_bundle({"truth": t, "codes": t.select("ssic_code")}, tmp_dir)
    assert spark.read.parquet(paths["truth"]).count() == t.count()
    assert set(paths) == {"truth", "codes"}


def test_page_text_stream(spark, tmp_dir):
    from codelens.streaming.pages import start_page_text

    src = os.path.join(tmp_dir, "src")
    read_table(spark, SF_SMALL, "pages").repartition(3).write.parquet(src)
    sink = os.path.join(tmp_dir, "sink")
    q = start_page_text(spark, src, sink, checkpoint=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() > 0
    assert out.where(F.col("text").isNull()).count() == 0


def test_scoring_stream(spark, tmp_dir):
    from codelens.plans.q_ml import fit_classifier
    from codelens.streaming.pages import start_scoring

    model = fit_classifier(spark, SF_SMALL, "Section")
    src = os.path.join(tmp_dir, "docs")
    FX.company_text(spark, SF_SMALL).select("doc_id", "text").write.parquet(src)
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(src)
    sink = os.path.join(tmp_dir, "scores")
    q = start_scoring(spark, stream, model, "doc_id", "text", 3, sink, checkpoint=os.path.join(tmp_dir, "ck2"))
    q.awaitTermination(180)
    out = spark.read.parquet(sink)
    from codelens.operators.ml import class_labels

    per_doc = min(3, len(class_labels(model)))
    assert out.count() == per_doc * FX.company_text(spark, SF_SMALL).count()


def test_read_declared_codes(spark, tmp_dir):
    p = os.path.join(tmp_dir, "declared.csv")
    _write(p, "UEN,entity_name,ssic_code,ssic_code2,oth_desc,oth_desc2,gsearch\n"
              "199900001A,ACME LTD.,1111,62011,x,,y\n199900002B,BETA,46900,,,,\n")
    rows = IO.read_declared_codes(spark, p).collect()
    assert [tuple(r) for r in rows] == [("199900001A", "ACME LTD.", "01111", "62011"), ("199900002B", "BETA", "46900", None)]


def test_read_link_lists(spark, tmp_dir):
    p = os.path.join(tmp_dir, "links.csv")
    _write(p, 'Company,Org Website,Filtered Links\nACME,https://acme.example,"[\'https://acme.example/about\', \'/profile\']"\n'
              "BETA,,[]\n")
    rows = IO.read_link_lists(spark, p).collect()
    assert rows[0]["links"] == ["https://acme.example/about", "/profile"] and rows[1]["links"] == []
    assert rows[1]["site"] is None
