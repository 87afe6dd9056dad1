"""Queries over files: each customer becomes a file whose features follow from its row, so that SQL on the table tells
what every relation, rewrite and conformance rule must find in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import codecs
from folioframe.functions import scalar as fn
from folioframe.operators import corpus
from folioframe.plans import rules
from folioframe.plans.catalog import Tables
from folioframe.plans.runtime import scratch
from folioframe.sources import builder, editing, pdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_C = "c AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nk, c_acctbal AS bal, c_mktsegment AS seg, 1 + c_nationkey % 3 AS np, c_mktsegment IN ('BUILDING', 'MACHINERY') AS packed FROM customer)"
_PAGES = "p AS (SELECT *, unnest(range(0, np))::INT AS i FROM c)"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return keep


def customer_file(key: int, name: str, nk: int, bal: float, seg: str) -> dict:
    """The specification of a customer's file."""
    ns = builder.NAMESPACES
    n = 1 + nk % 3
    pages = []
    for i in range(n):
        page = {"lines": [[f"{name} page {i}", "H1" if i == 0 else "P", 0], [seg, None if nk == 2 else "Artifact", None]]}
        if i == 1:
            page["rotate"] = 90
        if i == 0:
            link = {"subtype": "Link", "flags": 0 if nk == 10 else 4, "action": "Launch" if nk == 12 else "GoTo", "oc": 0}
            page["annots"] = [link if nk == 8 else link | {"contents": f"see {name}"}]
            page["tabs"] = None if nk == 15 else "S"
            page["ops"] = "1 0 0 rg " if nk in (4, 5) else ""
            page["media"] = [0, 0, 2, 2] if nk == 6 else None
            page["images"] = [[2 + nk % 3, 2, "DeviceGray"]] if seg == "AUTOMOBILE" else None
        pages.append(page)
    nodes = [[0, "Document", {}, None, None], [1, "H1", {}, 0, 0]] + [[1, "P", {}, i, 0] for i in range(1, n)]
    extra = {16: "Note", 17: "H3", 18: "Figure", 19: "Chapter", 20: "Odd"}.get(nk)
    nodes += [[1, extra, {}, None, None]] if extra else []
    nodes += [] if nk == 23 else [[1, "Link", {"Obj": [0, 0]}, None, None]]
    nodes += [[1, "Table", {}, None, None]]
    table = len(nodes)
    scope = {} if nk == 21 else {"Scope": "Column"}
    nodes += [[table, "TR", {}, None, None], [table + 1, "TH", scope, None, None], [table + 1, "TH", scope, None, None], [table, "TR", {}, None, None]]
    nodes += [[table + 4, "TD", {}, None, None]] * (1 if nk == 22 else 2)
    xmp = [[ns["dc"], "dc", "title", name]] + ([[ns["pdfaid"], "pdfaid", "part", "2"], [ns["pdfaid"], "pdfaid", "conformance", "B"]] if seg != "HOUSEHOLD" else [])
    xmp += ([] if nk == 5 else [[ns["pdfuaid"], "pdfuaid", "part", "1"]]) + ([[ns["pdf"], "pdf", "Other", "x"]] if nk == 9 else [])
    return {
        "version": f"1.{4 + nk % 4}", "packed": seg in ("BUILDING", "MACHINERY"), "broken": nk == 7 and seg not in ("BUILDING", "MACHINERY"), "update": f"Revised {name}" if bal > 5000 else None,
        "tail": "tail" if nk == 3 else "", "info": {"title": name}, "lang": None if nk == 11 else "en_US" if bal < 0 else "en", "xmp": xmp, "marked": nk != 13, "suspects": nk == 14,
        "show_title": seg != "FURNITURE", "pages": pages, "structure": nodes, "roles": {"Chapter": "Sect"} | ({"A": "B", "B": "A"} if nk == 24 else {}),
        "fonts": [{"name": "ABCDEF+Sans", "embedded": seg != "HOUSEHOLD", "unicode": nk % 2 == 0}] + ([{"name": "Serif"}] if nk == 16 else []),
        "outline": [[0, "Top", 0], [1, seg, n - 1]], "labels": [[0, "r", None, None], [1, "D", "A-", 5]], "dests": {"start": 0, "end": n - 1},
        "files": [{"name": f"{name}.txt", "text": seg, "relation": "Data", "uf": nk != 24}] if bal > 8000 else [],
        "intents": [{"subtype": "GTS_PDFA1", "identifier": "own", "space": "RGB"}] if nk % 5 else [],
        "fields": [[None, "f", "Tx", seg, 1], [0, "x", None, None, None], [0, "y", "Btn", None, 4]], "layers": [{"name": seg, "visible": bal >= 0}],
        "actions": [{"S": "GoTo"}, {"S": "Named", "N": "Print" if nk == 1 else "NextPage"}],
    }


def customer_files(t: Tables) -> DataFrame:
    """doc_id (the key), data."""
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    # A file's rows are small against the work on it, so that rows are dealt out anew where the table has few files.
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, pdf.parts_of(rows)))
    return builder.from_rows(rows, "c_custkey", customer_file)


def relations(t: Tables) -> pdf.Relations:
    return pdf.Relations(customer_files(t))


def _k(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.col("doc_id").cast("bigint")).drop("doc_id")


# Relations.

@query(f"""WITH {_C} SELECT k, '1.' || (4 + nk % 4) AS version, nk = 7 AND NOT packed AS rebuilt, np AS n_pages, CASE WHEN nk = 3 THEN 4 ELSE 0 END AS tail,
  CASE WHEN bal > 5000 THEN 'Revised ' ELSE '' END || name AS title, nk <> 11 AS has_lang FROM c""")
def file_documents(t):
    d = relations(t).of(doc=("doc_id", "version", "rebuilt", "n_pages", "bytes_after_eof", "title", "has_lang")).doc
    return _k(d).select("k", "version", "rebuilt", "n_pages", F.greatest(F.col("bytes_after_eof") - 1, F.lit(0)).alias("tail"), "title", "has_lang")


@query(f"WITH {_C} SELECT k, CASE WHEN packed THEN 'packed' ELSE 'used' END AS catalog_kind, CASE WHEN bal > 5000 THEN 1 ELSE 0 END AS sections_before FROM c WHERE nk <> 7 OR packed")
def file_cross_references(t):
    return _k(relations(t).xref_use.where("NOT rebuilt").select("doc_id", "catalog_kind", F.col("depth").alias("sections_before")))


@query(f"""WITH {_C}, n AS (SELECT k, unnest([{{'type': 'Page', 'n': np}}, {{'type': 'Font', 'n': 1 + (nk = 16)::INT}}, {{'type': 'Annot', 'n': 1}}, {{'type': 'OCG', 'n': 1}}, {{'type': 'Action', 'n': 2}},
  {{'type': 'StructElem', 'n': np + 9 + (nk BETWEEN 16 AND 20)::INT - (nk = 23)::INT - (nk = 22)::INT}}, {{'type': 'Filespec', 'n': (bal > 8000)::INT}}]) AS x FROM c)
  SELECT k, x.type AS type, x.n::BIGINT AS n FROM n WHERE x.n > 0""")
def file_objects_by_type(t):
    o = relations(t).of(obj=("doc_id", "type")).obj.where(F.col("type").isin("Page", "Font", "Annot", "OCG", "Action", "StructElem", "Filespec"))
    return _k(o.groupBy("doc_id", "type").agg(F.count("*").alias("n")))


@query(f"WITH {_C} SELECT k, x.path AS path, x.type AS type FROM (SELECT k, unnest([{{'path': '/Pages', 'type': 'Pages'}}, {{'path': '/Metadata', 'type': 'Metadata'}}, {{'path': '/StructTreeRoot', 'type': 'StructTreeRoot'}}, {{'path': '/Outlines', 'type': 'Outlines'}}]) AS x FROM c) z")
def file_references(t):
    r = relations(t)
    return _k(r.referenced().where("src = 1").where(F.col("path").isin("/Pages", "/Metadata", "/StructTreeRoot", "/Outlines")).select("doc_id", "path", "type"))


@query(f"WITH {_C} SELECT k, np AS n_content, (1 + (nk % 5 <> 0)::INT + (nk % 2 = 0)::INT + (seg <> 'HOUSEHOLD')::INT + (seg = 'AUTOMOBILE')::INT + (bal > 8000)::INT)::BIGINT AS n_other, 0::BIGINT AS n_broken FROM c")
def file_streams(t):
    r = relations(t).together(["obj", "stream"])
    typed = r.stream.join(r.obj.select("doc_id", "obj_num", "type", "body"), ["doc_id", "obj_num"]).where("type IS NULL OR type NOT IN ('ObjStm', 'XRef')")
    plain = F.col("type").isNull() & F.array_contains("filters", "FlateDecode")
    return _k(typed.groupBy("doc_id").agg(F.count_if(plain).cast("int").alias("n_content"), F.count_if(~plain).alias("n_other"), F.count_if(F.col("error").isNotNull() | (F.col("declared_length") != F.col("raw_length"))).alias("n_broken")))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, CASE WHEN i = 1 THEN 90 END AS rotate, CASE WHEN nk = 6 AND i = 0 THEN 2.0 ELSE 612.0 END::DOUBLE AS width FROM p")
def file_pages(t):
    return _k(relations(t).page.select("doc_id", "page_idx", "rotate", (F.col("media_box")[2] - F.col("media_box")[0]).alias("width")))


@query(f"""WITH {_C}, {_PAGES} SELECT k, i AS page_idx, x.op AS op, x.n::BIGINT AS n FROM (SELECT k, i, unnest([{{'op': 'Tj', 'n': 2}}, {{'op': 'T*', 'n': 2}}, {{'op': 'BDC', 'n': 1}}, {{'op': 'BMC', 'n': (nk <> 2)::INT}},
  {{'op': 'EMC', 'n': 1 + (nk <> 2)::INT}}, {{'op': 'rg', 'n': (i = 0 AND nk IN (4, 5))::INT}}, {{'op': 'BT', 'n': 1}}]) AS x FROM p) z WHERE x.n > 0""")
def file_operators(t):
    return _k(relations(t).content_op.where(F.col("op").isin("Tj", "T*", "BDC", "BMC", "EMC", "rg", "BT")).groupBy("doc_id", "page_idx", "op").agg(F.count("*").alias("n")))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, name || ' page ' || i || chr(10) || seg AS text FROM p")
def file_page_text(t):
    return _k(relations(t).page_text)


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, name || ' page ' || i AS text, 'ABCDEF+Sans' AS font_name, 10.0::DOUBLE AS font_size, 0 AS text_offset, 0 AS mcid FROM p UNION ALL SELECT k, i, seg, 'ABCDEF+Sans', 10.0, length(name || ' page ' || i) + 1, NULL FROM p")
def file_fragments(t):
    return _k(relations(t).text_fragment.select("doc_id", "page_idx", "text", "font_name", "font_size", "text_offset", "mcid"))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, 0 AS mcid, name || ' page ' || i AS text FROM p")
def file_marked_text(t):
    return _k(relations(t).together(["text_fragment", "page_text"]).mcid_text())


@query(f"""WITH {_C}, {_PAGES}, h AS (SELECT k, 2 + i AS node, 1 AS parent, CASE WHEN i = 0 THEN 'H1' ELSE 'P' END AS type, name || ' page ' || i AS text FROM p)
  SELECT * FROM h UNION ALL SELECT k, 1, 0, 'Document', '' FROM c UNION ALL SELECT k, np + 2 + (nk BETWEEN 16 AND 20)::INT, 1, 'Link', '' FROM c WHERE nk <> 23""")
def file_tag_tree(t):
    r = relations(t).together(["text_fragment", "page_text", "struct_node", "content_item"])
    return _k(r.tag_tree().where("type IN ('Document', 'H1', 'P', 'Link')").select("doc_id", "node", "parent", "type", "text"))


@query(f"WITH {_C} SELECT k, 0 AS page_idx, 'Link' AS subtype, CASE WHEN nk = 10 THEN 0 ELSE 4 END AS flags, CASE WHEN nk <> 8 THEN 'see ' || name END AS contents FROM c")
def file_annotations(t):
    return _k(relations(t).annot.select("doc_id", "page_idx", "subtype", "flags", F.substr(rules.val("body", "$.Contents"), F.lit(3)).alias("contents")))


@query(f"WITH {_C} SELECT k, (np + 2 + (nk BETWEEN 16 AND 20)::INT)::INT AS node FROM c WHERE nk <> 23")
def file_annotation_parents(t):
    r = relations(t).together(["object_ref", "annot"])
    return _k(r.annot.join(r.annotation_parents(), ["doc_id", "obj_num"]).select("doc_id", "node"))


@query(f"WITH {_C} SELECT k, 'Chapter' AS src, 'Sect' AS dst FROM c UNION ALL SELECT k, 'A', 'B' FROM c WHERE nk = 24 UNION ALL SELECT k, 'B', 'A' FROM c WHERE nk = 24")
def file_role_maps(t):
    return _k(relations(t).role_map)


@query(f"""WITH {_C}, u AS (SELECT k, list_sort(list_distinct(list_transform(regexp_extract_all(name || ' page ' || substr('012', 1, np::INT) || seg, '.'), lambda x: ascii(x)))) AS codes FROM c)
  SELECT k, 'ABCDEF+Sans' AS base_font, 'ABCDEF' AS subset_tag, seg <> 'HOUSEHOLD' AS is_embedded, nk % 2 = 0 AS has_to_unicode, array_to_string(codes, ',') AS used_codes, array_to_string(range(0, np), ',') AS pages_used_on FROM c JOIN u USING (k)
  UNION ALL SELECT k, 'Serif', NULL, false, false, '', '' FROM c WHERE nk = 16""")
def file_font_inventory(t):
    r = relations(t)
    return _k(r.font_inventory().select("doc_id", "base_font", "subset_tag", "is_embedded", "has_to_unicode", F.array_join("used_codes", ",").alias("used_codes"), F.array_join("pages_used_on", ",").alias("pages_used_on")))


@query(f"WITH {_C} SELECT k, 95::BIGINT AS n_codes, 32 AS first, 126 AS last, bool_and(true) AS same FROM c WHERE nk % 2 = 0 GROUP BY k")
def file_code_maps(t):
    return _k(relations(t).code_map_use.groupBy("doc_id").agg(F.sum("n_codes").alias("n_codes"), F.min("first").alias("first"), F.max("last").alias("last"), F.bool_and("same").alias("same")))


@query(f"WITH {_C} SELECT k, name || '.txt' AS name, 'text/plain' AS mime, 'Data' AS relationship, md5(seg) AS content_md5 FROM c WHERE bal > 8000")
def file_embedded(t):
    return _k(relations(t).embedded_file.select("doc_id", "name", "mime", "relationship", F.md5("data").alias("content_md5")))


@query(f"WITH {_C} SELECT k, 'GTS_PDFA1' AS subtype, 'own' AS identifier, 'Output' AS class, 'RGB' AS space, '2.4.0' AS version FROM c WHERE nk % 5 <> 0")
def file_intents(t):
    r = relations(t).together(["output_intent", "icc_profile"])
    return _k(r.output_intent.join(r.icc_profile, (r.output_intent["doc_id"] == r.icc_profile["doc_id"]) & (F.col("profile_ref") == F.col("obj_num"))).select(r.output_intent["doc_id"], "subtype", "identifier", "class", "space", "version"))


@query(f"""WITH {_C} SELECT k, 'title' AS name, 'alt' AS form, 'x-default' AS lang, name AS value FROM c UNION ALL SELECT k, 'part', 'simple', NULL, '2' FROM c WHERE seg <> 'HOUSEHOLD'
  UNION ALL SELECT k, 'conformance', 'simple', NULL, 'B' FROM c WHERE seg <> 'HOUSEHOLD' UNION ALL SELECT k, 'part', 'simple', NULL, '1' FROM c WHERE nk <> 5 UNION ALL SELECT k, 'Other', 'simple', NULL, 'x' FROM c WHERE nk = 9""")
def file_metadata(t):
    return _k(relations(t).xmp_prop.select("doc_id", "name", "form", "lang", "value"))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, CASE WHEN i = 0 THEN 'i' ELSE 'A-' || (4 + i) END AS label FROM p")
def file_page_labels(t):
    r = relations(t).of(page=("doc_id", "page_idx")).together(["page", "page_label"])
    return _k(corpus.page_labels(r.page.select("doc_id", "page_idx"), r.page_label))


@query(f"WITH {_C} SELECT k, 'start' AS name, 0 AS page_idx FROM c UNION ALL SELECT k, 'end', (np - 1)::INT FROM c")
def file_destinations(t):
    return _k(relations(t).named_dest)


@query(f"WITH {_C} SELECT k, 1 AS node, 0 AS parent, 'Top' AS title FROM c UNION ALL SELECT k, 2, 1, seg FROM c")
def file_outlines(t):
    return _k(relations(t).outline.select("doc_id", "node", "parent", "title"))


@query(f"""WITH {_C} SELECT k, 'f' AS full_name, 'Tx' AS type, seg AS value, 1 AS flags, false AS is_terminal FROM c UNION ALL SELECT k, 'f.x', 'Tx', seg, 1, true FROM c
  UNION ALL SELECT k, 'f.y', 'Btn', seg, 4, true FROM c""")
def file_form_fields(t):
    return _k(relations(t).form_field.select("doc_id", "full_name", "type", "value", "flags", "is_terminal"))


@query(f"WITH {_C} SELECT k, seg AS name, bal >= 0 AS visible, bal >= 0 AS annot_visible FROM c")
def file_layers(t):
    return _k(relations(t).layer_use.select("doc_id", "name", "visible", F.explode("annots").alias("annot_visible")))


@query(f"""WITH {_C} SELECT k, 'open' AS origin, 0 AS depth, 'GoTo' AS s, NULL AS n FROM c UNION ALL SELECT k, 'open', 1, 'Named', CASE WHEN nk = 1 THEN 'Print' ELSE 'NextPage' END FROM c
  UNION ALL SELECT k, 'annot0', 0, CASE WHEN nk = 12 THEN 'Launch' ELSE 'GoTo' END, NULL FROM c""")
def file_actions(t):
    return _k(relations(t).action.select("doc_id", "origin", "depth", "s", "n"))


@query(f"WITH {_C} SELECT k, 0 AS page_idx, (2 + nk % 3)::INT AS width, 2 AS height, 8 AS bits, 'DeviceGray' AS space, ((2 + nk % 3) * 2)::BIGINT AS n_bytes FROM c WHERE seg = 'AUTOMOBILE'")
def file_images(t):
    return _k(relations(t).page_image.select("doc_id", "page_idx", "width", "height", "bits", "space", "n_bytes"))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, 'F1' AS name FROM p UNION ALL SELECT k, i, 'F2' FROM p WHERE nk = 16")
def file_font_resources(t):
    return _k(relations(t).resource_use.where("category = 'Font' AND owner = 0").select("doc_id", "page_idx", "name"))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, CASE WHEN i = 0 AND nk IN (4, 5) THEN 'RGB' ELSE '' END AS device, nk = 2 AS untagged, i > 0 OR seg <> 'AUTOMOBILE' AS falls_back FROM p")
def file_content_use(t):
    return _k(relations(t).page_use.select("doc_id", "page_idx", F.array_join("device", ",").alias("device"), "untagged", (F.size("fallback") > 0).alias("falls_back")))


@query(f"WITH {_C} SELECT k, 0::BIGINT AS n_dead FROM c")
def file_live_objects(t):
    dead = F.expr("NOT live AND (type IS NULL OR type NOT IN ('ObjStm', 'XRef'))")
    return _k(relations(t).object_use.groupBy("doc_id").agg(F.count_if(dead).alias("n_dead")))


@query(f"WITH {_C} SELECT k, true AS headings_ok, true AS ends_ok, CASE WHEN packed AND bal <= 5000 THEN 0 WHEN NOT packed AND bal > 5000 THEN 2 ELSE 1 END::BIGINT AS n_tables FROM c")
def file_spacing(t):
    r = relations(t).together(["object_spacing", "xref_section", "doc"])
    s = r.object_spacing.groupBy("doc_id").agg(F.bool_and("heading_ok").alias("headings_ok"), F.bool_and("end_ok").alias("ends_ok"))
    x = r.xref_section.where("spacing_ok").groupBy("doc_id").agg(F.count("*").alias("n"))
    return _k(s.join(x, "doc_id", "left").select("doc_id", "headings_ok", "ends_ok", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_tables")))


# Rules.

def _expected(each: dict[str, str]) -> str:
    rows = ", ".join(f"{{'rule_id': '{k}', 'n': ({v})::BIGINT}}" for k, v in each.items())
    return f"WITH {_C} SELECT k, x.rule_id AS rule_id, x.n AS n FROM (SELECT k, unnest([{rows}]) AS x FROM c) z WHERE x.n > 0"


def _one(when: str) -> str:
    return f"CASE WHEN {when} THEN 1 ELSE 0 END"


def _findings(t, profile: str) -> DataFrame:
    return _k(rules.check(relations(t), profile).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n")))


_FONTS = "CASE WHEN seg = 'HOUSEHOLD' THEN 1 ELSE 0 END + CASE WHEN nk = 16 THEN 1 ELSE 0 END"
_BOTH = {"font-embedded": _FONTS, "embedded-file": _one("nk = 24 AND bal > 8000")}


@query(_expected(_BOTH | {
    "post-eof": _one("nk = 3"), "implementation-limits": _one("nk = 6"), "pdfa-id": _one("seg = 'HOUSEHOLD'"), "pdfa-xmp-property-predefined": _one("nk = 9"), "annotation-flags": _one("nk = 10"),
    "action-type": _one("nk IN (1, 12)"), "device-colour": _one("nk = 5"), "explicit-resources": "np - CASE WHEN seg = 'AUTOMOBILE' THEN 1 ELSE 0 END",
}))
def rules_archive(t):
    return _findings(t, "A-2b")


@query(_expected(_BOTH | {
    "ua-identification": _one("nk = 5"), "ua-tagged": _one("nk = 13"), "ua-suspects": _one("nk = 14"), "ua-display-doc-title": _one("seg = 'FURNITURE'"), "ua-standard-type": _one("nk = 20"),
    "ua-role-map": "CASE WHEN nk = 24 THEN 2 ELSE 0 END", "ua-figure-alt": _one("nk = 18"), "ua-headings": _one("nk = 17"), "ua-object-lang": _one("nk = 11"), "ua-language-tag": _one("bal < 0 AND nk <> 11"),
    "ua-annotation": "CASE WHEN nk = 8 THEN 2 WHEN nk IN (15, 23) THEN 1 ELSE 0 END", "ua-note-id": _one("nk = 16"), "ua-content-tagged": _one("nk = 2"), "ua-content-lang": "CASE WHEN nk = 11 THEN 2 ELSE 0 END",
    "ua-table-regular": _one("nk = 22"), "ua-table-header": _one("nk = 21"),
}))
def rules_accessible(t):
    return _findings(t, "UA-1")


@query(_expected({"font-embedded": _FONTS, "pdfx-output-intent": "1", "pdfx-page-boxes": "np", "pdfx-trapped": "1", "pdfx-version": "1", "pdfx-device-colour": _one("nk IN (4, 5)")}))
def rules_print(t):
    return _findings(t, "X-4")


# Rewriting.

@query(f"WITH {_C} SELECT k, 1::BIGINT AS n_pages, name || ' page 0' || chr(10) || seg AS text FROM c")
def file_extracted(t):
    r = pdf.Relations(pdf.extracted(customer_files(t), 0, 1))
    return _k(r.page_text.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max("text").alias("text")))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, CASE WHEN i = 1 THEN 180 ELSE 90 END AS rotate FROM p")
def file_rotated(t):
    return _k(pdf.Relations(pdf.rotated(customer_files(t), 90)).of(page=("doc_id", "page_idx", "rotate")).page.select("doc_id", "page_idx", "rotate"))


@query(f"WITH {_C}, {_PAGES} SELECT seg, count(*) AS n_pages, md5(string_agg(name || ' page ' || i || chr(10) || seg, chr(10) || chr(10) ORDER BY k, i)) AS text_md5 FROM p GROUP BY seg")
def file_merged(t):
    keys = t.customer.select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("k"))
    r = pdf.Relations(pdf.merged(customer_files(t).join(keys, "doc_id"), "seg", "k")).together(["page_text"])
    pages = r.page_text.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return r.document_text().join(pages, "doc_id").select(F.col("doc_id").alias("seg"), "n_pages", F.md5("text").alias("text_md5"))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, name || ' page ' || i || chr(10) || seg || chr(10) || 'Copy' AS text FROM p")
def file_stamped(t):
    return _k(pdf.Relations(editing.stamped(customer_files(t), "Copy")).page_text)


@query(f"WITH {_C} SELECT k, 'Text' AS subtype, 'note' AS contents FROM c")
def file_reannotated(t):
    files = editing.with_annotation(editing.without_annotations(customer_files(t), ["Link"]), 0, "Text", [0, 0, 9, 9], "note")
    return _k(pdf.Relations(files).annot.select("doc_id", "subtype", F.substr(rules.val("body", "$.Contents"), F.lit(3)).alias("contents")))


@query(f"WITH {_C} SELECT k, 'creator' AS name, 'me & you' AS value FROM c")
def file_metadata_written(t):
    return _k(pdf.Relations(editing.with_metadata(customer_files(t), [[builder.NAMESPACES["dc"], "dc", "creator", "me & you"]])).xmp_prop.select("doc_id", "name", "value"))


@query(f"WITH {_C}, {_PAGES} SELECT k, i AS page_idx, 'P-' || CASE i WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END AS label FROM p")
def file_relabelled(t):
    r = pdf.Relations(editing.with_labels(customer_files(t), [(0, "R", "P-", None)])).of(page=("doc_id", "page_idx")).together(["page", "page_label"])
    return _k(corpus.page_labels(r.page.select("doc_id", "page_idx"), r.page_label))


@query(f"WITH {_C}, {_PAGES} SELECT k, (np - 1 - i)::INT AS page_idx, name || ' page ' || i || chr(10) || seg AS text FROM p")
def file_reversed(t):
    return _k(pdf.Relations(editing.reordered(customer_files(t), lambda n: list(range(n))[::-1])).page_text)


@query(f"WITH {_C} SELECT k, 0::BIGINT AS n_fields FROM c")
def file_flattened(t):
    return _k(pdf.Relations(editing.flattened(customer_files(t))).form_use)


@query(f"WITH {_C}, {_PAGES} SELECT k, md5(string_agg(name || ' page ' || i || chr(10) || seg, chr(10) || chr(10) ORDER BY i)) AS text_md5, true AS not_larger FROM p GROUP BY k")
def file_optimised(t):
    files = customer_files(t)
    done = pdf.Relations(pdf.optimised(files)).document_text().select("doc_id", F.md5("text").alias("text_md5"))
    report = editing.optimise_report(files).select("doc_id", ((F.col("objects_after") <= F.col("objects_before")) & (F.col("streams_deflated") >= 0)).alias("not_larger"))
    return _k(done.join(report, "doc_id"))


@query(f"WITH {_C} SELECT k, np AS n_pages, CASE WHEN bal > 5000 THEN 'Revised ' ELSE '' END || name AS title FROM c")
def file_saved(t):
    folder = scratch(t.spark)
    editing.save(customer_files(t), folder)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_extract("path", r"doc_id=([^/]+)", 1).alias("doc_id"), F.col("content").alias("data"))
    return _k(pdf.Relations(files).doc.select("doc_id", "n_pages", F.substr(rules.val("info", "$.Title"), F.lit(3)).alias("title")))


# Codecs, names, dates and reports.

@query("SELECT item_id, x.codec AS codec, md5(text) AS text_md5 FROM (SELECT item_id, text, unnest([{'codec': 'ASCII85Decode'}, {'codec': 'ASCIIHexDecode'}, {'codec': 'FlateDecode'}, {'codec': 'LZWDecode'}, {'codec': 'RunLengthDecode'}]) AS x FROM benchmark) z")
def codec_round_trip(t):
    import zlib

    encoders = {"ASCII85Decode": codecs.ascii85_encode, "ASCIIHexDecode": codecs.asciihex_encode, "FlateDecode": zlib.compress, "LZWDecode": codecs.lzw_encode, "RunLengthDecode": codecs.runlength_encode}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, out = [], [], []
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for codec, encode in encoders.items():
                    ids.append(i)
                    names.append(codec)
                    out.append(codecs.decode(encode(text.encode()), [codec], [{}]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(out, pa.binary())], names=["item_id", "codec", "data"])

    done = t.benchmark.select(F.col("item_id").cast("bigint"), "text").mapInArrow(run, "item_id bigint, codec string, data binary")
    return done.select("item_id", "codec", F.md5("data").alias("text_md5"))


_CASE = "'suite ' || CASE WHEN p_size < 20 THEN '' || p_size ELSE (p_size // 10) || '-' || (p_size % 10) || '-1' END || '-t' || lpad((p_size % 7)::VARCHAR, 2, '0') || CASE WHEN p_brand LIKE '%1' THEN '-pass-a' WHEN p_brand LIKE '%2' THEN '-fail-b' ELSE '-skip-c' END || '.pdf'"


@query(f"""SELECT p_partkey, CASE WHEN p_size < 20 THEN '' || p_size ELSE (p_size // 10) || '.' || (p_size % 10) || '.1' END AS clause, (p_size % 7)::INT AS test, p_brand LIKE '%1' AS expected_pass,
  CASE WHEN p_brand LIKE '%1' THEN 'a' ELSE 'b' END AS variant FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%2'""")
def case_names(t):
    clause = F.when(F.col("p_size") < 20, F.col("p_size").cast("string")).otherwise(F.concat((F.col("p_size") / 10).cast("int").cast("string"), F.lit("-"), (F.col("p_size") % 10).cast("string"), F.lit("-1")))
    end = F.when(F.col("p_brand").like("%1"), "-pass-a").when(F.col("p_brand").like("%2"), "-fail-b").otherwise("-skip-c")
    path = F.concat(F.lit("suite "), clause, F.lit("-t"), F.lpad((F.col("p_size") % 7).cast("string"), 2, "0"), end, F.lit(".pdf"))
    return t.part.select("p_partkey", corpus.case_of(path).alias("c")).where("c IS NOT NULL").select("p_partkey", "c.*")


@query(f"WITH {_C} SELECT name || '.pdf' AS file_name, seg <> 'MACHINERY' AND bal >= 0 AS compliant, CASE WHEN seg <> 'MACHINERY' AND bal < 0 THEN '6.' || nk || '/' || nk % 3 ELSE '' END AS failed FROM c")
def verdict_reports(t):
    rule = "<rule clause='6.%s' testNumber='%s' status='%s'/>"
    text = F.when(
        F.col("c_mktsegment") != "MACHINERY",
        F.concat(
            F.lit("<validationReport isCompliant='"), (F.col("c_acctbal") >= 0).cast("string"), F.lit("'><details>"),
            *[F.format_string(rule, F.col("c_nationkey").cast("string"), (F.col("c_nationkey") % 3).cast("string"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("passed"))] * 2,
            F.lit("</details></validationReport>"),
        ),
    ).otherwise("")

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (["<report>"], *(b.column(0) for b in batches), ["</report>"]):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()) if isinstance(part, list) else part], names=["value"])

    folder = scratch(t.spark)
    jobs = t.customer.select(F.concat(F.lit("<job><item><name>/x/"), F.col("c_name"), F.lit(".pdf</name></item>"), text, F.lit("</job>")).alias("value"))
    jobs.mapInArrow(rooted, "value string").write.text(folder)
    got = corpus.read_verdicts(t.spark, folder)
    return got.select("file_name", "compliant", F.array_join(F.transform("failed", lambda x: F.concat_ws("/", x["clause"], x["test"])), ",").alias("failed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN o_orderpriority LIKE '1%' THEN strftime(o_orderdate, '%Y-01-01 00:00:00') END AS ts,
  CASE WHEN o_orderstatus = 'F' THEN -150 WHEN o_orderpriority LIKE '1%' THEN 0 END AS offset_minutes FROM orders""")
def date_forms(t):
    full = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("-02'30'"))
    year = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyy"))
    form = F.when(F.col("o_orderstatus") == "F", full).when(F.col("o_orderpriority").like("1%"), year).when(F.col("o_orderpriority").like("2%"), F.concat(year, F.lit(" trailing"))).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    d = t.orders.select("o_orderkey", fn.parse_pdf_date(form).alias("d"))
    return d.select("o_orderkey", F.date_format("d.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "d.offset_minutes")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN o_orderstatus = 'F' THEN 330 ELSE 0 END AS offset_minutes FROM orders WHERE o_orderstatus <> 'P'""")
def iso_dates(t):
    zone = F.when(F.col("o_orderstatus") == "F", "+05:30").when(F.col("o_orderstatus") == "O", "Z").otherwise("?")
    d = t.orders.select("o_orderkey", fn.parse_iso_date(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)).alias("d")).where("d IS NOT NULL")
    return d.select("o_orderkey", F.date_format("d.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "d.offset_minutes")
