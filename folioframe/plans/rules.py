"""Conformance rules as queries over the relations of page-description files.

A rule is a function from relations to findings (doc_id, message, and where known severity, page_index, object_number).
Values of a wrong type never make a finding. `check` writes the relations that rules share once, runs the rules of one
profile and unites their findings; a file that cannot be read has one `document-load` error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from inspect import signature
from types import CodeType, FunctionType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.scalar import LANGUAGE_TAG
from folioframe.operators import graph
from folioframe.plans.runtime import written
from folioframe.sources.pdf import Relations

# Profiles as bits.
PROFILES = {"A-2b": 1, "A-2u": 2, "A-3b": 4, "X-4": 8, "UA-1": 16}
PDFA, ALL, X4, UA = 7, 15, 8, 16

# Fixed values of the standards.
STREAM_FILTERS = ["ASCIIHexDecode", "ASCII85Decode", "FlateDecode", "RunLengthDecode", "CCITTFaxDecode", "JBIG2Decode", "DCTDecode", "JPXDecode", "Crypt"]
INLINE_FILTERS = "ASCIIHexDecode AHx ASCII85Decode A85 FlateDecode Fl RunLengthDecode RL CCITTFaxDecode CCF DCTDecode DCT".split()
OPERATORS = "b B b* B* BDC BI BMC BT BX c cm CS cs d d0 d1 Do DP EI EMC ET EX f F f* G g gs h i ID j J K k l m M MP n q Q re RG rg ri s S SC sc SCN scn sh T* Tc Td TD Tf Tj TJ TL Tm Tr Ts Tw Tz v w W W* y ' \"".split()
INTENTS = ["RelativeColorimetric", "AbsoluteColorimetric", "Perceptual", "Saturation"]
BLEND_MODES = "Normal Compatible Multiply Screen Overlay Darken Lighten ColorDodge ColorBurn HardLight SoftLight Difference Exclusion Hue Saturation Color Luminosity".split()
ANNOTATIONS = "Text Link FreeText Line Square Circle Polygon PolyLine Highlight Underline Squiggly StrikeOut Stamp Caret Ink Popup FileAttachment Widget PrinterMark TrapNet Watermark Redact".split()
ACTIONS = "GoTo GoToR GoToE Thread URI Named SubmitForm".split()
NAMED_ACTIONS = "NextPage PrevPage FirstPage LastPage".split()
STRUCTURE = (
    "Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot "
    "Span Quote Note Reference BibEntry Code Link Annot Ruby RB RT RP Warichu WT WP Figure Formula Form"
).split()
PROCESS = ("Cyan", "Magenta", "Yellow", "Black")
CMAP_NAME = r"^(Identity|Uni(GB|CNS|JIS|KS)-(UCS2|UTF16)(-HW)?|GB-EUC|GBpc-EUC|GBK-EUC|GBKp-EUC|GBK2K|B5pc|HKscs-B5|ETen-B5|ETenms-B5|CNS-EUC|(83pv|90ms|90msp|90pv|Add|Ext)-RKSJ|EUC|KSC-EUC|KSCms-UHC(-HW)?|KSCpc-EUC)-[HV]$|^[HV]$"
# Properties of the schemas that most files use, and the forms of those that are no simple texts.
XMP_PROPERTIES = {
    "http://purl.org/dc/elements/1.1/": "contributor coverage creator date description format identifier language publisher relation rights source subject title type".split(),
    "http://ns.adobe.com/xap/1.0/": "Advisory BaseURL CreateDate CreatorTool Identifier Label MetadataDate ModifyDate Nickname Rating Thumbnails".split(),
    "http://ns.adobe.com/xap/1.0/rights/": "Certificate Marked Owner UsageTerms WebStatement".split(),
    "http://ns.adobe.com/pdf/1.3/": "Keywords PDFVersion Producer Trapped".split(),
    "http://www.aiim.org/pdfa/ns/id/": "part amd conformance corr rev".split(),
}
_DC = "http://purl.org/dc/elements/1.1/"
XMP_FORMS = {(_DC, n): f for f, names in (("alt", "description rights title"), ("bag", "contributor language publisher relation subject type"), ("seq", "creator date")) for n in names.split()} | {("http://ns.adobe.com/xap/1.0/rights/", "UsageTerms"): "alt", ("http://ns.adobe.com/xap/1.0/rights/", "Owner"): "bag", ("http://ns.adobe.com/xap/1.0/", "Identifier"): "bag"}
PARENTS = {"LI": ["L"], "LBody": ["LI"], "TR": ["Table", "THead", "TBody", "TFoot"], "TH": ["TR"], "TD": ["TR"], "THead": ["Table"], "TBody": ["Table"], "TFoot": ["Table"], "TOCI": ["TOC"]}


@dataclass
class Rule:
    id: str
    profiles: int
    clause: str
    find: Callable


RULES: list[Rule] = []


def rule(id_: str, profiles: int, clause: str):
    def keep(f):
        RULES.append(Rule(id_, profiles, clause, f))
        return f

    return keep


def val(body: str, path: str, kind: str = "string") -> Column:
    """A typed value at a path of a body, null if it is not there or of another type."""
    return F.try_variant_get(F.try_parse_json(F.col(body)), path, kind)


def has(body: str, path: str) -> Column:
    v = F.try_variant_get(F.try_parse_json(F.col(body)), path, "variant")
    return v.isNotNull() & ~F.is_variant_null(v)


def is_kind(body: str, path: str, kind: str) -> Column:
    """Whether the value is an object, array, boolean, or number; texts are `STRING`."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(body)), path, "variant")).startswith(kind), F.lit(False))


def name(body: str, path: str) -> Column:
    """A name's text, null for anything else."""
    v = val(body, path)
    return F.when(v.startswith("/"), F.substr(v, F.lit(2)))


def true(body: str, path: str) -> Column:
    return F.coalesce(val(body, path, "boolean"), F.lit(False)) & is_kind(body, path, "BOOLEAN")


def docs(r, when: Column, message: str, severity: str | Column = "Error") -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return r.doc.where("error IS NULL").where(when).select("doc_id", F.lit(message).alias("message"), level.alias("severity"))


def objs(df: DataFrame, message: Column | str) -> DataFrame:
    return df.select("doc_id", (F.lit(message) if isinstance(message, str) else message).alias("message"), F.col("obj_num").alias("object_number"))


def pages(df: DataFrame, message: Column | str) -> DataFrame:
    return df.select("doc_id", (F.lit(message) if isinstance(message, str) else message).alias("message"), F.col("page_idx").alias("page_index"))


def once_a_value(df: DataFrame, value: str, message: str) -> DataFrame:
    return df.select("doc_id", F.concat(F.lit(message), F.col(value)).alias("message")).distinct()


# File structure.

@rule("encrypt", ALL, "6.1.3")
def encrypt(r):
    return docs(r, has("trailer", "$.Encrypt"), "the trailer has Encrypt")


@rule("file-id", ALL, "6.1.3")
def file_id(r):
    ids = val("trailer", "$.ID", "array<string>")
    bad = ids.isNull() | (F.size(ids) == 0) | F.coalesce(F.element_at(ids, -1).isin("s:"), F.lit(False))
    odd = (F.size(ids) != 2) | F.exists(ids, lambda x: ~x.startswith("s:"))
    first = docs(r, bad, "the trailer has no file identifier")
    return first.unionByName(docs(r, ~bad & odd, "the file identifier is not two strings", "Warning"))


@rule("post-eof", PDFA, "6.1.3")
def post_eof(r):
    return docs(r, F.col("bytes_after_eof") > 0, "data follow the last end-of-file marker")


@rule("file-header", PDFA, "6.1.2")
def file_header(r):
    return docs(r, (F.col("header_offset") != 0) | ~F.col("version").rlike(r"^1\.[0-7]$") | ~F.col("binary_marker"), "the header is not at the start or lacks the binary comment")


def _side(box: str) -> Column:
    w, h = F.abs(F.col(box)[2] - F.col(box)[0]), F.abs(F.col(box)[3] - F.col(box)[1])
    return F.coalesce((F.least(w, h) < 3) | (F.greatest(w, h) > 14400), F.lit(False))


@rule("implementation-limits", PDFA, "6.1.13")
def limits(r):
    out = pages(r.page.where(_side("media_box") | _side("crop_box")), "a page boundary is under 3 or over 14400 units")
    for column, message in (("long_strings", "a string has over 32767 bytes"), ("long_names", "a name has over 127 bytes")):
        out = out.unionByName(objs(r.limit.where(F.col(column) > 0), message), allowMissingColumns=True)
    out = out.unionByName(pages(r.page_use.where("long_strings > 0"), "a string of page content has over 32767 bytes"), allowMissingColumns=True)
    # One finding a document, whichever side has the integer.
    big = r.limit.where("big_integers > 0").select("doc_id").unionByName(r.page_use.where("big_integers > 0").select("doc_id")).distinct()
    return out.unionByName(big.select("doc_id", F.lit("an integer has over 32 bits").alias("message")), allowMissingColumns=True)


@rule("hex-string-format", PDFA, "6.1.6")
def hex_format(r):
    odd = r.hex_string.where("n_odd > 0").select("doc_id", F.lit("a hexadecimal string has an odd number of digits").alias("message"))
    return odd.unionByName(r.hex_string.where("n_bad > 0").select("doc_id", F.lit("a hexadecimal string has other characters than digits").alias("message")))


@rule("permissions", PDFA, "6.1.12")
def permissions(r):
    keys = F.json_object_keys(F.get_json_object("catalog", "$.Perms"))
    other = docs(r, F.exists(keys, lambda k: ~k.isin("UR3", "DocMDP")), "Perms has another key than UR3 and DocMDP")
    signed = r.doc.where(F.exists(keys, lambda k: k == "DocMDP")).select("doc_id")
    digests = r.obj.where(F.col("body").rlike(r'"Reference": \[.*"Digest(?:Method|Value|Location)":')).join(signed, "doc_id", "left_semi")
    return other.select("doc_id", "message").unionByName(objs(digests, "a signature reference has a digest"), allowMissingColumns=True)


@rule("stream-filters", PDFA, "6.1.7.2")
def stream_filters(r):
    return objs(r.stream.where(F.exists("filters", lambda f: ~f.isin(STREAM_FILTERS))), "a stream filter is not permitted")


@rule("stream-external-file", ALL, "6.1.7.1")
def stream_external(r):
    return objs(r.obj.where("kind = 'stream'").where(has("body", "$.F") | has("body", "$.FFilter") | has("body", "$.FDecodeParms")), "a stream refers to an external file")


@rule("stream-object", PDFA, "6.1.7.1")
def stream_object(r):
    return objs(r.stream.where("declared_length <> raw_length"), "a stream's Length is not its real length")


@rule("name-utf8", PDFA, "6.1.8")
def name_utf8(r):
    names = r.obj.select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(r'"(/[^"]*)"'), F.lit(1))).alias("n")).distinct()
    bad = names.where(~F.is_valid_utf8(F.encode("n", "ISO-8859-1").cast("string")))
    return once_a_value(bad, "n", "a name is not valid UTF-8: ")


@rule("metadata", ALL, "6.6.2.1")
def metadata(r):
    return docs(r, ~true("catalog", "$.Metadata['#stream']"), "the catalog has no Metadata stream")


@rule("xmp-packet-header", PDFA, "6.6.2.1")
def xmp_header(r):
    return docs(r, F.col("xmp").rlike(r"<\?xpacket begin[^?]*\b(bytes|encoding)="), "the packet header has bytes or encoding")


def _xmp(prefix: str, field: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce("xmp", F.lit("")), rf"{prefix}:{field}\s*(?:=\s*[\"']|>)\s*([^\"'<]*)", 1), F.lit(""))


@rule("pdfa-id", PDFA, "6.6.4")
def pdfa_id(r, profile: str = "A-2b"):
    part, level = profile[2], profile[3].upper()
    ok = _xmp("pdfaid", "part").eqNullSafe(F.lit(part)) & _xmp("pdfaid", "conformance").eqNullSafe(F.lit(level))
    return docs(r, ~ok, f"the metadata do not claim {profile}")


@rule("indirect-object-spacing", PDFA, "6.1.9")
def object_spacing(r):
    return objs(r.object_spacing.where("NOT heading_ok OR NOT end_ok"), "an object's heading or end is not spaced as it should be")


@rule("xref-spacing", PDFA, "6.1.4")
def xref_spacing(r):
    return r.xref_section.where("NOT spacing_ok").select("doc_id", F.lit("a cross-reference table is not spaced as it should be").alias("message"))


# Colour and graphics.

@rule("output-intent-profile", ALL, "6.2.3")
def intent_profile(r):
    icc = r.icc_profile.select("doc_id", F.col("obj_num").alias("profile_ref"), "class", "space", "version")
    each = r.output_intent.where("has_profile AND profile_ref IS NOT NULL").join(icc, ["doc_id", "profile_ref"], "left")
    good = F.col("class").isin("Output", "Display") & F.col("space").isin("RGB", "CMYK", "Gray") & (F.split("version", r"\.")[0].cast("int") < 5)
    return each.where(~F.coalesce(good, F.lit(False))).select("doc_id", F.lit("an output intent's profile is damaged or of a kind that is not permitted").alias("message"), F.col("profile_ref").alias("object_number"))


@rule("pdfa2u-tounicode-values", 2 | UA, "6.2.11.7")
def unicode_values(r, profile: str = "A-2u"):
    bad = ["\u0000", "\ufffe", "\ufeff"] + ([] if profile == "UA-1" else ["\uffff"])
    wrong = F.lit(profile != "UA-1") & (F.col("text") == "")
    for c in bad:
        wrong = wrong | F.contains("text", F.lit(c))
    return once_a_value(r.code_map.where(wrong), "base_font", "a code maps to a value that is not permitted in ")


@rule("output-intent-single", PDFA, "6.2.3")
def intent_single(r):
    each = F.coalesce("profile_ref", -1 - F.col("ord"))
    many = r.output_intent.where("has_profile").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct(each).alias("k")).where("n > 1 AND k > 1")
    return many.select("doc_id", F.lit("output intents have different profiles").alias("message"))


@rule("font-embedded", ALL | UA, "6.2.11.4")
def font_embedded(r):
    return objs(r.font.where("kind <> 'Type3' AND NOT is_embedded"), F.concat(F.lit("the font is not embedded: "), F.col("base_font")))


@rule("content-stream-operator", PDFA, "6.2.2")
def content_operator(r):
    bad = r.content_op.where(~F.col("op").isin(OPERATORS)).groupBy("doc_id", "op").agg(F.min("page_idx").alias("page_idx"))
    return pages(bad, F.concat(F.lit("an operator is not defined: "), F.col("op")))


def _states(r) -> DataFrame:
    return r.obj.where("type = 'ExtGState'")


@rule("graphics-state", PDFA, "6.2.5")
def graphics_state(r):
    bad = has("body", "$.TR") | has("body", "$.HTP") | (has("body", "$.TR2") & ~name("body", "$.TR2").eqNullSafe(F.lit("Default")))
    states = objs(_states(r).where(bad), "a graphics state has TR, HTP or a TR2 that is not Default")
    # Halftones stand alone or inside a state.
    loose = r.obj.select("doc_id", "obj_num", F.coalesce(F.get_json_object("body", "$.HT"), F.col("body")).alias("ht")).where(has("ht", "$.HalftoneType"))
    odd = ~F.coalesce(val("ht", "$.HalftoneType", "bigint").isin(1, 5), F.lit(False)) | has("ht", "$.HalftoneName")
    return states.unionByName(objs(loose.where(odd), "a halftone is not of type 1 or 5, or has a name"))


@rule("rendering-intent", PDFA, "6.2.6")
def rendering_intent(r):
    a = _states(r).select("doc_id", name("body", "$.RI").alias("v"))
    b = r.obj.where("kind = 'stream' AND subtype = 'Image'").select("doc_id", name("body", "$.Intent").alias("v"))
    c = r.content_op.where("op = 'ri'").select("doc_id", name("operands", "$[0]").alias("v"))
    return once_a_value(a.unionByName(b).unionByName(c).where(F.col("v").isNotNull() & ~F.col("v").isin(INTENTS)), "v", "a rendering intent is not defined: ")


@rule("prohibited-xobject", PDFA, "6.2.9")
def prohibited_xobject(r):
    form = (F.col("subtype") == "Form") & (has("body", "$.OPI") | has("body", "$.PS") | has("body", "$.Ref") | (name("body", "$.Subtype2") == "PS"))
    return objs(r.obj.where("kind = 'stream'").where(F.coalesce(form, F.lit(False)) | F.coalesce(F.col("subtype") == "PS", F.lit(False))), "an XObject is not permitted")


@rule("image-dictionary", PDFA, "6.2.8")
def image_dictionary(r):
    image = r.obj.where("kind = 'stream' AND subtype = 'Image'")
    bits, mask = val("body", "$.BitsPerComponent", "bigint"), true("body", "$.ImageMask")
    bad = has("body", "$.Alternates") | has("body", "$.OPI") | true("body", "$.Interpolate") | F.coalesce(F.when(mask, bits != 1).otherwise(~bits.isin(1, 2, 4, 8, 16)), F.lit(False))
    return objs(image.where(bad), "an image has Alternates, OPI, Interpolate or another number of bits")


@rule("inline-image", PDFA, "6.2.8")
def inline_image(r):
    one = F.when(val("operands", "$[0].F").startswith("/"), F.array(val("operands", "$[0].F")))
    named = F.coalesce(val("operands", "$[0].F", "array<string>"), one, F.when(val("operands", "$[0].Filter").startswith("/"), F.array(val("operands", "$[0].Filter"))), val("operands", "$[0].Filter", "array<string>"))
    bad = true("operands", "$[0].I") | true("operands", "$[0].Interpolate") | F.coalesce(F.exists(named, lambda f: ~f.isin([f"/{x}" for x in INLINE_FILTERS])), F.lit(False))
    return pages(r.content_op.where("op = 'BI'").where(bad), "an inline image is interpolated or has a filter that is not permitted")


@rule("pdfx-blend-mode", X4, "6.20")
def blend_mode(r):
    modes = F.coalesce(F.transform(val("body", "$.BM", "array<string>"), lambda x: x), F.array(val("body", "$.BM")))
    return objs(_states(r).where(F.exists(modes, lambda m: m.startswith("/") & ~F.substr(m, F.lit(2)).isin(BLEND_MODES))), "a blend mode is not defined")


# Annotations, forms, actions.

@rule("annotation-type", PDFA, "6.3.1")
def annotation_type(r):
    kind = F.coalesce("subtype", F.lit("none"))
    return pages(r.annot.where(~kind.isin(ANNOTATIONS)), F.concat(F.lit("an annotation type is not permitted: "), kind))


@rule("annotation-flags", PDFA, "6.3.2")
def annotation_flags(r):
    f = F.col("flags")
    wrong = (f.bitwiseAND(4) == 0) | (f.bitwiseAND(1 | 2 | 32 | 256) != 0)
    return pages(r.annot.where(~F.col("subtype").eqNullSafe(F.lit("Popup"))).where(f.isNull() | wrong), "an annotation's flags do not make it print")


@rule("annotation-appearance", PDFA, "6.3.3")
def annotation_appearance(r):
    box = val("body", "$.Rect", "array<double>")
    empty = F.coalesce((F.size(box) == 4) & (box[0] == box[2]) & (box[1] == box[3]), F.lit(False))
    keys = F.json_object_keys(F.get_json_object("body", "$.AP"))
    rest = r.annot.where(~empty & ~F.coalesce(F.col("subtype").isin("Popup", "Link"), F.lit(False)))
    lacking = pages(rest.where(keys.isNull() | ~F.array_contains(keys, "N") | (F.size(keys) > 1)), "an annotation lacks a normal appearance or has another one")
    button = rest.where("subtype = 'Widget'").where(name("body", "$.FT").eqNullSafe(F.lit("Btn")) & true("body", "$.AP.N['#stream']"))
    return lacking.unionByName(pages(button, "a button's normal appearance is one stream"))


@rule("form-field-actions", PDFA, "6.4.1")
def field_actions(r):
    widgets = pages(r.annot.where("subtype = 'Widget'").where(has("body", "$.A") | has("body", "$.AA")), "a widget has an action")
    fields = r.form_field.where("has_aa").select("doc_id", F.concat(F.lit("a field has additional actions: "), F.col("full_name")).alias("message"))
    return widgets.unionByName(fields, allowMissingColumns=True)


@rule("form-config", PDFA, "6.4.1")
def form_config(r):
    return docs(r, true("catalog", "$.AcroForm.NeedAppearances") | has("catalog", "$.AcroForm.XFA") | true("catalog", "$.NeedsRendering"), "the form needs rendering or has XFA")


@rule("action-type", PDFA, "6.5.1")
def action_type(r):
    known = F.coalesce(F.col("n").isin(NAMED_ACTIONS), F.lit(False))
    bad = r.action.where(~F.col("s").isin(ACTIONS) | ((F.col("s") == "Named") & ~known))
    return bad.select("doc_id", F.concat(F.lit("an action is not permitted: "), F.col("s")).alias("message"), F.col("obj_num").alias("object_number")).distinct()


@rule("additional-actions", PDFA, "6.5.2")
def additional_actions(r):
    return docs(r, has("catalog", "$.AA"), "the catalog has additional actions").select("doc_id", "message").unionByName(pages(r.page.where(has("body", "$.AA")), "a page has additional actions"), allowMissingColumns=True)


# Files, layers, presentation.

@rule("embedded-file", PDFA | UA, "6.8")
def embedded_file(r):
    spec = r.obj.where("kind = 'dict'").where(has("body", "$.EF"))
    return objs(spec.where(~has("body", "$.F") | ~has("body", "$.UF")), "a file specification lacks F or UF")


@rule("optional-content", PDFA | UA, "6.9")
def optional_content(r):
    both = F.concat(F.coalesce(F.array(F.get_json_object("catalog", "$.OCProperties.D")), F.array()), F.coalesce(F.from_json(F.get_json_object("catalog", "$.OCProperties.Configs"), "array<string>"), F.array()))
    configs = r.doc.where("error IS NULL").where(has("catalog", "$.OCProperties")).select("doc_id", F.posexplode(both).alias("ord", "body")).where("body IS NOT NULL")
    named = configs.withColumn("n", val("body", "$.Name"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "n").orderBy("ord"))
    bad = named.withColumn("nth", nth).where("n IS NULL OR n = 's:' OR nth > 1").select("doc_id", F.lit("a layer configuration has no name of its own").alias("message"))
    return bad.unionByName(configs.where(has("body", "$.AS")).select("doc_id", F.lit("a layer configuration has AS").alias("message")))


@rule("alternate-presentations", PDFA, "6.10")
def alternate_presentations(r):
    return docs(r, has("catalog", "$.Names.AlternatePresentations"), "the catalog has alternate presentations").select("doc_id", "message").unionByName(pages(r.page.where(has("body", "$.PresSteps")), "a page has presentation steps"), allowMissingColumns=True)


@rule("document-requirements", PDFA, "6.11")
def requirements(r):
    return docs(r, has("catalog", "$.Requirements"), "the catalog has requirements")


@rule("pdfx-output-intent", X4, "6.2")
def pdfx_intent(r):
    n = r.output_intent.groupBy("doc_id").agg(F.count_if(F.col("subtype") == "GTS_PDFX").alias("n"), F.count_if((F.col("subtype") == "GTS_PDFX") & F.col("has_profile")).alias("k"))
    return r.doc.where("error IS NULL").join(n, "doc_id", "left").where("coalesce(n, 0) <> 1 OR coalesce(k, 0) <> 1").select("doc_id", F.lit("there is not exactly one print intent with a profile").alias("message"))


@rule("pdfx-page-boxes", X4, "6.12")
def pdfx_boxes(r):
    trim, art = val("body", "$.TrimBox", "array<double>"), val("body", "$.ArtBox", "array<double>")
    box, media = F.coalesce(trim, art), F.col("media_box")
    out = (box[0] < media[0]) | (box[1] < media[1]) | (box[2] > media[2]) | (box[3] > media[3])
    return pages(r.page.where((trim.isNull() == art.isNull()) | F.coalesce(out, F.lit(False))), "a page needs either a TrimBox or an ArtBox inside its MediaBox")


@rule("pdfx-trapped", X4, "6.13")
def trapped(r):
    return docs(r, ~F.coalesce(name("info", "$.Trapped").isin("True", "False"), F.lit(False)), "Trapped is neither True nor False")


@rule("pdfx-version", X4, "6.3")
def pdfx_version(r):
    return docs(r, ~F.coalesce(_xmp("pdfxid", "GTS_PDFXVersion").startswith("PDF/X-4"), F.lit(False)), "the metadata do not claim X-4")


# Accessibility.

@rule("ua-identification", UA, "5")
def ua_identification(r):
    return docs(r, ~_xmp("pdfuaid", "part").eqNullSafe(F.lit("1")), "the metadata do not claim UA-1")


@rule("ua-tagged", UA, "7.1")
def ua_tagged(r):
    return docs(r, ~has("catalog", "$.StructTreeRoot") | ~true("catalog", "$.MarkInfo.Marked"), "the document is not tagged")


@rule("ua-suspects", UA, "7.1")
def ua_suspects(r):
    return docs(r, true("catalog", "$.MarkInfo.Suspects"), "the document has suspects")


@rule("ua-display-doc-title", UA, "7.1")
def ua_display_title(r):
    return docs(r, ~true("catalog", "$.ViewerPreferences.DisplayDocTitle"), "the title is not displayed")


@rule("ua-title", UA, "7.1")
def ua_title(r):
    title = F.trim(F.regexp_extract(F.coalesce("xmp", F.lit("")), r"(?s)<dc:title>.*?<rdf:li[^>]*>([^<]*)<", 1))
    return docs(r, title == "", "the metadata have no title")


@rule("ua-xfa", UA, "7.15")
def ua_xfa(r):
    return docs(r, has("catalog", "$.AcroForm.XFA"), "the form has XFA")


@rule("ua-encryption", UA, "7.16")
def ua_encryption(r):
    bits = F.get_json_object("body", "$.P").cast("bigint")
    held = r.doc.where("error IS NULL").where(has("trailer", "$.Encrypt")).select("doc_id", F.regexp_extract(val("trailer", "$.Encrypt"), r"^r:(\d+)", 1).cast("int").alias("obj_num"))
    return held.join(r.obj, ["doc_id", "obj_num"], "left").where(bits.isNull() | (bits.bitwiseAND(512) == 0)).select("doc_id", F.lit("assistive software may not read the text").alias("message"))


def _types(r) -> DataFrame:
    """Structure nodes with their standard type, by the role map; written once for all rules of a check."""
    if "types" not in r.shared:
        standard = r.role_map.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STRUCTURE))).alias("name"))
        final = graph.closure(r.role_map.select(F.col("doc_id").alias("doc"), "src", "dst"), standard)
        final = final.select(F.col("doc").alias("doc_id"), F.col("src").alias("type"), "final")
        named = r.struct_node.join(final, ["doc_id", "type"], "left")
        r.shared["types"] = written(named.withColumn("std", F.when(F.col("type").isin(STRUCTURE), F.col("type")).otherwise(F.coalesce("final", "type"))))
    return r.shared["types"]


@rule("ua-standard-type", UA, "7.1")
def ua_standard_type(r):
    return once_a_value(_types(r).where("parent IS NOT NULL").where(~F.col("std").isin(STRUCTURE)), "type", "a structure type is not mapped to a standard one: ")


@rule("ua-role-map", UA, "7.1")
def ua_role_map(r):
    remapped = once_a_value(r.role_map.where(F.col("src").isin(STRUCTURE)), "src", "a standard type is remapped: ")
    loops = graph.on_cycles(r.role_map.select(F.col("doc_id").alias("doc"), "src", "dst"))
    return remapped.unionByName(loops.select(F.col("doc").alias("doc_id"), F.concat(F.lit("a role mapping is circular: "), F.col("src")).alias("message")))


@rule("ua-figure-alt", UA, "7.3")
def ua_figure(r):
    text = lambda k: F.coalesce(val("body", f"$.{k}"), F.lit("s:"))
    figures = _types(r).where(F.col("std").isin("Figure", "Formula")).where((text("Alt") == "s:") & ~has("body", "$.ActualText"))
    # Replacement text of marked content counts, on whatever page its number is.
    spoken = r.page_use.select("doc_id", F.explode("actual_text").alias("mcid")).distinct()
    covered = r.content_item.join(spoken, ["doc_id", "mcid"], "left_semi").select("doc_id", "node").distinct()
    bad = figures.where(has("body", "$.Alt")).unionByName(figures.where(~has("body", "$.Alt")).join(covered, ["doc_id", "node"], "left_anti"), allowMissingColumns=True)
    return bad.select("doc_id", F.concat(F.col("std"), F.lit(" without a text")).alias("message"))


@rule("ua-structure-nesting", UA, "7.2")
def ua_nesting(r):
    types = _types(r).select("doc_id", "node", "parent", "ord", "std")
    up = types.select("doc_id", F.col("node").alias("parent"), F.col("std").alias("above"))
    ok = F.lit(True)
    for child, parents in PARENTS.items():
        ok = F.when(F.col("std") == child, F.coalesce(F.col("above").isin(parents), F.lit(False))).otherwise(ok)
    inside = types.join(up, ["doc_id", "parent"]).where(~ok).select("doc_id", F.concat(F.col("std"), F.lit(" inside "), F.coalesce("above", F.lit("the root"))).alias("message"))
    late = types.join(up, ["doc_id", "parent"]).where("std = 'Caption' AND ord > 0 AND above IN ('L', 'TOC')")
    return inside.unionByName(late.select("doc_id", F.concat(F.lit("a caption is not the first child of "), F.col("above")).alias("message")))


@rule("ua-headings", UA, "7.4.2")
def ua_headings(r):
    types = _types(r).select("doc_id", "node", "parent", "std")
    heads = types.where(F.col("std").rlike("^H[1-6]$")).withColumn("level", F.substr("std", F.lit(2)).cast("int"))
    seq = heads.withColumn("previous", F.lag("level").over(Window.partitionBy("doc_id").orderBy("node")))
    bad = seq.where(F.when(F.col("previous").isNull(), F.col("level") != 1).otherwise(F.col("level") > F.col("previous") + 1))
    skips = bad.select("doc_id", F.concat(F.lit("a heading skips a level: "), F.col("std")).alias("message"))
    # Nodes of the root have parent 0, which is no element.
    several = types.where("std = 'H' AND parent > 0").groupBy("doc_id", "parent").agg(F.count("*").alias("n")).where("n > 1")
    mixed = types.groupBy("doc_id").agg(F.bool_or(F.col("std") == "H").alias("a"), F.bool_or(F.col("std").rlike("^H[1-6]$")).alias("b")).where("a AND b")
    return skips.unionByName(several.select("doc_id", F.lit("an element has more than one H").alias("message"))).unionByName(mixed.select("doc_id", F.lit("H and numbered headings are mixed").alias("message")))


@rule("ua-attribute-lang", UA, "7.2")
def ua_attribute_lang(r):
    nodes = r.struct_node.select(F.col("doc_id").alias("doc"), "node", "parent", val("body", "$.Lang").alias("lang"), (has("body", "$.Alt") | has("body", "$.ActualText") | has("body", "$.E")).alias("texts"))
    lang = graph.inherited(nodes, "lang")
    without = nodes.where("texts").drop("lang", "parent").join(lang.where("lang IS NULL"), ["doc", "node"]).select(F.col("doc").alias("doc_id"), "node")
    return without.join(r.doc.where(~has("catalog", "$.Lang")), "doc_id").select("doc_id", F.lit("a text attribute has no language").alias("message"))


@rule("ua-object-lang", UA, "7.2")
def ua_object_lang(r):
    return docs(r, ~has("catalog", "$.Lang"), "outline entries have no language").join(r.outline, "doc_id", "left_semi")


@rule("ua-language-tag", UA, "7.2")
def ua_language_tag(r):
    tags = r.doc.where("error IS NULL").select("doc_id", val("catalog", "$.Lang").alias("t")).unionByName(r.struct_node.select("doc_id", val("body", "$.Lang").alias("t")))
    tags = tags.where(F.col("t").startswith("s:")).select("doc_id", F.substr("t", F.lit(3)).alias("t"))
    return once_a_value(tags.where(~F.col("t").rlike(LANGUAGE_TAG)), "t", "a language tag is malformed: ")


@rule("ua-annotation", UA, "7.18")
def ua_annotation(r):
    box = val("body", "$.Rect", "array<double>")
    crop = r.page.select("doc_id", "page_idx", F.col("body").alias("page_body"), F.coalesce("crop_box", "media_box").alias("crop"))
    outside = F.coalesce((F.size(box) == 4) & ((F.greatest(box[0], box[2]) < F.least(F.col("crop")[0], F.col("crop")[2])) | (F.least(box[0], box[2]) > F.greatest(F.col("crop")[0], F.col("crop")[2])) | (F.greatest(box[1], box[3]) < F.least(F.col("crop")[1], F.col("crop")[3])) | (F.least(box[1], box[3]) > F.greatest(F.col("crop")[1], F.col("crop")[3]))), F.lit(False))
    shown = r.annot.join(crop, ["doc_id", "page_idx"]).where(~outside & (F.coalesce("flags", F.lit(0)).bitwiseAND(2) == 0) & ~F.col("subtype").eqNullSafe(F.lit("Popup")))
    types = _types(r).select("doc_id", "node", F.col("std").alias("above"), F.coalesce(val("body", "$.Alt"), F.lit("s:")).alias("alt"))
    parents = r.object_ref.groupBy("doc_id", "obj_num").agg(F.max("node").alias("node")).join(types, ["doc_id", "node"]).select("doc_id", "obj_num", "above", "alt")
    tree = r.struct_node.where("parent IS NULL").select("doc_id", F.lit(True).alias("tagged"))
    shown = written(shown.join(parents, ["doc_id", "obj_num"], "left").join(tree, "doc_id", "left").select("doc_id", "page_idx", "subtype", "above", "alt", "tagged", name("page_body", "$.Tabs").alias("tabs"), F.coalesce(val("body", "$.Contents"), F.lit("s:")).alias("contents")))
    tabs = pages(shown.where(~F.col("tabs").eqNullSafe(F.lit("S"))).select("doc_id", "page_idx").distinct(), "a page with annotations does not follow the structure")
    net = pages(shown.where("subtype = 'TrapNet'"), "a TrapNet annotation is not permitted")
    link = pages(shown.where("subtype = 'Link' AND contents = 's:'"), "a link has no Contents")
    mute = pages(shown.where("coalesce(subtype, '') NOT IN ('Widget', 'PrinterMark') AND contents = 's:' AND coalesce(alt, 's:') = 's:'"), "an annotation has no description")
    want = F.when(F.col("subtype") == "Widget", "Form").when(F.col("subtype") == "Link", "Link").otherwise("Annot")
    nested = pages(shown.where("tagged AND coalesce(subtype, '') <> 'PrinterMark'").where(~F.col("above").eqNullSafe(want)), F.concat(F.lit("an annotation is not inside "), want))
    mark = pages(shown.where("tagged AND subtype = 'PrinterMark' AND above IS NOT NULL"), "a printer's mark is in the structure")
    return tabs.unionByName(net).unionByName(link).unionByName(mute).unionByName(nested).unionByName(mark)


@rule("ua-media-clip", UA, "7.18.6")
def ua_media_clip(r):
    return objs(r.obj.where("kind = 'dict' AND type = 'MediaClip'").where(~has("body", "$.CT") | ~is_kind("body", "$.Alt", "ARRAY")), "a media clip lacks CT or Alt")


@rule("ua-note-id", UA, "7.9")
def ua_note(r):
    notes = _types(r).where("std = 'Note'").withColumn("id", val("body", "$.ID"))
    n = F.count("*").over(Window.partitionBy("doc_id", "id"))
    bad = notes.withColumn("n", n).where("id IS NULL OR id = 's:' OR n > 1")
    return bad.select("doc_id", F.lit("a note has no ID of its own").alias("message"))


@rule("ua-reference-xobject", UA, "7.20")
def ua_reference(r):
    return objs(r.obj.where("kind = 'stream' AND subtype = 'Form'").where(has("body", "$.Ref")), "a form XObject refers to another document")


def _first_page(df: DataFrame, message: str) -> DataFrame:
    return pages(df.groupBy("doc_id").agg(F.min("page_idx").alias("page_idx")), message)


@rule("ua-content-tagged", UA, "7.1")
def ua_content_tagged(r):
    return _first_page(r.page_use.where("untagged"), "content is neither tagged nor an artifact")


@rule("ua-artifact-nesting", UA, "7.1")
def ua_artifact_nesting(r):
    return _first_page(r.page_use.where("nested"), "an artifact and tagged content are inside one another")


@rule("ua-xobject-mcid", UA, "7.20")
def ua_xobject_mcid(r):
    many = r.do_edge.groupBy("doc_id", F.col("dst").alias("obj_num")).agg(F.sum("n").alias("n"), F.bool_or("marked").alias("marked")).where("n > 1 AND marked AND obj_num >= 0")
    return objs(many, "a form XObject with marked content is drawn more than once")


@rule("ua-text-unicode", UA, "7.21.7")
def ua_text_unicode(r):
    return once_a_value(r.font_use.where("size(unmapped) > 0"), "base_font", "a shown code has no text in ")


@rule("pdfa2u-tounicode", 2, "6.2.11.7")
def a2u_unicode(r):
    return once_a_value(r.font_use.where("size(unmapped) > 0"), "base_font", "a shown code has no text in ")


@rule("ua-content-lang", UA, "7.2")
def ua_content_lang(r):
    without = r.doc.where("error IS NULL").where(~has("catalog", "$.Lang")).select("doc_id")
    owner = r.object_ref.groupBy("doc_id", "obj_num").agg(F.max("node").alias("node")).join(r.struct_node.select("doc_id", "node", has("body", "$.Lang").alias("covered")), ["doc_id", "node"]).select("doc_id", "obj_num", "covered")
    annots = r.annot.where(val("body", "$.Contents") > "s:").where(~has("body", "$.Lang")).join(owner, ["doc_id", "obj_num"], "left").where("NOT coalesce(covered, false)")
    fields = r.form_field.where("tu <> '' AND lang IS NULL")
    alternatives = r.xmp_prop.where("form = 'alt'").groupBy("doc_id", "namespace", "name").agg(F.bool_and(F.col("lang") == "x-default").alias("only")).where("only")
    out = annots.select("doc_id", F.lit("an annotation's description has no language").alias("message"))
    out = out.unionByName(fields.select("doc_id", F.concat(F.lit("a field's description has no language: "), F.col("full_name")).alias("message")))
    out = out.unionByName(alternatives.select("doc_id", F.concat(F.lit("a metadata property has no language: "), F.col("name")).alias("message")))
    return out.join(without, "doc_id", "left_semi")


def _tables(r) -> DataFrame:
    """doc_id, node of each table with its rows of cells in order: array<array<struct<...>>>; rows may be empty."""
    if "tables" in r.shared:
        return r.shared["tables"]
    types = _types(r).select("doc_id", "node", "parent", "std", "body")
    up = types.select("doc_id", F.col("node").alias("parent"), F.col("std").alias("above"), F.col("parent").alias("above_parent"))
    rows = types.where("std = 'TR'").join(up, ["doc_id", "parent"])
    top = types.where("std = 'Table'").select("doc_id", F.col("node").alias("table"))
    rows = rows.withColumn("table", F.when(F.col("above") == "Table", F.col("parent")).when(F.col("above").isin("THead", "TBody", "TFoot"), F.col("above_parent")))
    rows = rows.join(top, ["doc_id", "table"], "left_semi").select("doc_id", "table", F.col("node").alias("row"))
    # Attributes are one dictionary or an array of them; the last that has a key counts.
    held = F.coalesce(F.from_json(F.get_json_object("body", "$.A"), "array<struct<RowSpan:int,ColSpan:int,Scope:string,Headers:array<string>>>"), F.array())
    last = lambda k: F.element_at(F.filter(F.transform(held, lambda a: a[k]), lambda v: v.isNotNull()), -1)
    some = lambda k: F.when(F.exists(held, lambda a: a[k].isNotNull()), last(k))
    cells = types.where("std IN ('TH', 'TD')").select("doc_id", F.col("parent").alias("row"), "node", (F.col("std") == "TH").alias("th"), F.coalesce(some("RowSpan"), F.lit(1)).alias("rows"), F.coalesce(some("ColSpan"), F.lit(1)).alias("cols"), some("Scope").alias("scope"), F.coalesce(some("Headers"), F.array().cast("array<string>")).alias("headers"), val("body", "$.ID").alias("id"))
    line = rows.join(cells, ["doc_id", "row"], "left").groupBy("doc_id", "table", "row").agg(F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "th", "rows", "cols", "scope", "headers", "id")))).alias("cells"))
    r.shared["tables"] = written(line.groupBy("doc_id", F.col("table").alias("node")).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("lines")))
    return r.shared["tables"]


def table_grid(lines: list[list[dict]]) -> tuple[dict[tuple[int, int], tuple], int, str | None]:
    """The slots of a table (slot -> cell, its row, its column), its width, and what is irregular first: cells that share
    a slot, a span beyond the last row, rows of different width."""
    slots: dict[tuple[int, int], tuple] = {}
    width, shared, beyond = 0, False, False
    for r, cells in enumerate(lines):
        c = 0
        for cell in cells:
            while (r, c) in slots:
                c += 1
            for y in range(r, r + cell["rows"]):
                beyond |= y >= len(lines)
                for x in range(c, c + cell["cols"]):
                    shared |= (y, x) in slots
                    slots.setdefault((y, x), (cell, r, c))
            c += cell["cols"]
            width = max(width, c)
    if shared:
        return slots, width, "cells of a table overlap"
    if beyond:
        return slots, width, "a cell spans rows beyond the table"
    full = all((r, c) in slots for r in range(len(lines)) for c in range(width))
    return slots, width, None if full else "the rows of a table are not equally wide"


def unheaded_cell(lines: list[list[dict]]) -> str | None:
    """The first data cell of a regular table that no header belongs to; none where every header cell has a scope."""
    slots, width, irregular = table_grid(lines)
    heads = [c for row in lines for c in row if c["th"]]
    if not lines or irregular or all(h["scope"] for h in heads):
        return None
    ids = {h["id"] for h in heads if h["id"] and h["id"] != "s:"}

    def scoped(line: list[tuple[int, int]], want: str) -> bool:
        met = False
        for at in line:
            cell = slots[at][0]
            if cell["th"] and cell["scope"] in ("/Both", want):
                return True
            if met and not cell["th"]:
                return False
            met |= cell["th"]
        return False

    for r in range(len(lines)):
        for c in range(width):
            cell, top, left = slots[r, c]
            if cell["th"] or (top, left) != (r, c) or (r, c) == (0, 0):
                continue
            known = [h in ids for h in cell["headers"]]
            if known and all(known):
                continue
            ups = any(scoped([(y, x) for y in range(r - 1, -1, -1)], "/Column") for x in range(c, min(c + cell["cols"], width)))
            if ups or any(scoped([(y, x) for x in range(c - 1, -1, -1)], "/Row") for y in range(r, min(r + cell["rows"], len(lines)))):
                continue
            return "a data cell refers to unknown headers" if known else "a data cell has no header"
    return None


def _each_table(r, judge: Callable[[list[list[dict]]], str | None]) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [judge([x["cells"] for x in lines]) for lines in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "message"])

    return _tables(r).mapInArrow(run, "doc_id string, message string").where("message IS NOT NULL")


@rule("ua-table-regular", UA, "7.5")
def ua_table_regular(r):
    return _each_table(r, lambda lines: table_grid(lines)[2])


@rule("ua-table-header", UA, "7.5")
def ua_table_header(r):
    return _each_table(r, unheaded_cell)


@rule("explicit-resources", PDFA, "6.2.2")
def explicit_resources(r):
    owners = r.page_use.select("doc_id", F.explode("fallback").alias("owner"), "page_idx")
    on_page = pages(owners.where("owner = 0"), "a page names resources that only an ancestor has")
    inside = owners.where("owner <> 0").select("doc_id", F.col("owner").alias("obj_num")).distinct()
    return on_page.unionByName(objs(inside, "a form names resources that only its user has"), allowMissingColumns=True)


def _intents(r, subtype: str) -> DataFrame:
    """doc_id and the colour family of its intent's profile."""
    icc = r.icc_profile.select("doc_id", F.col("obj_num").alias("profile_ref"), "space")
    held = r.output_intent.where(F.col("subtype") == subtype).where("has_profile").join(icc, ["doc_id", "profile_ref"], "left")
    return held.groupBy("doc_id").agg(F.min_by(F.coalesce("space", F.lit("Other")), "ord").alias("intent"))


def _uncovered(used: DataFrame, family: str, intents: DataFrame) -> DataFrame:
    """Rows whose device family the intent does not cover: RGB and CMYK need their own kind, Gray any."""
    both = used.join(intents, "doc_id", "left")
    return both.where((F.col(family).isin("RGB", "CMYK") & ~F.col("intent").eqNullSafe(F.col(family))) | ((F.col(family) == "Gray") & F.col("intent").isNull()))


def _device(r, subtype: str) -> DataFrame:
    used = r.page_use.select("doc_id", F.explode("device").alias("family")).distinct()
    return _uncovered(used, "family", _intents(r, subtype)).select("doc_id", F.concat(F.lit("device colour without an output intent for it: "), F.col("family")).alias("message"))


@rule("device-colour", PDFA, "6.2.4.3")
def device_colour(r):
    return _device(r, "GTS_PDFA1")


@rule("pdfx-device-colour", X4, "6.2.2")
def pdfx_device_colour(r):
    return _device(r, "GTS_PDFX")


def _family(space: str) -> Column:
    return F.when(F.col(space).isin("DeviceGray", "DeviceRGB", "DeviceCMYK"), F.substr(F.col(space), F.lit(7)))


@rule("transparency-colour", PDFA, "6.2.10")
def transparency_colour(r):
    facts = r.page_use.where("transparent").join(_intents(r, "GTS_PDFA1"), "doc_id", "left")
    undefined = facts.where("blend_space IS NULL AND intent IS NULL")
    out = pages(undefined, "a page with transparency has no blending space")
    blends = r.page_use.where("transparent").select("doc_id", "page_idx", _family("blend_space").alias("family")).where("family IS NOT NULL")
    out = out.unionByName(pages(_uncovered(blends, "family", _intents(r, "GTS_PDFA1")), "a blending space has no output intent"))
    return out.unionByName(blend_mode(r), allowMissingColumns=True)


@rule("pdfx-transparency-colour", X4, "6.18")
def pdfx_transparency_colour(r):
    groups = r.group.select("doc_id", "obj_num", _family("space").alias("family")).where("family IS NOT NULL")
    return objs(_uncovered(groups, "family", _intents(r, "GTS_PDFX")), "a transparency group's device space has no output intent")


@rule("icc-cmyk-overprint", PDFA, "6.2.4.2")
def icc_overprint(r):
    return pages(r.page_use.where("icc_overprint"), "overprint mode 1 with a profiled CMYK colour")


@rule("pdfx-separation-consistency", ALL, "6.2.4.4")
def separation_consistency(r):
    each = r.colorant.where("kind = 'Separation' AND name NOT IN ('', 'None', 'All')")
    many = each.groupBy("doc_id", "name").agg(F.count_distinct(F.struct("alternate", "tint")).alias("n")).where("n > 1")
    return many.select("doc_id", F.concat(F.lit("a colorant is defined in two ways: "), F.col("name")).alias("message"))


@rule("pdfx-nchannel-colorants", ALL, "6.2.4.4")
def nchannel_colorants(r, profile: str = "A-2b"):
    spots = r.colorant.where("kind = 'DeviceN' AND NOT in_colorants").where(~F.col("name").isin("None", "All", *PROCESS))
    return once_a_value(spots.where("nchannel") if profile == "X-4" else spots, "name", "a spot colour is not among Colorants: ")


@rule("jpeg2000", PDFA, "6.2.8.3")
def jpeg2000(r):
    best = F.filter("specs", lambda x: x["approx"] == 1)
    spec = F.when(F.size(best) > 0, best[0]).when(F.size("specs") == 1, F.col("specs")[0])
    own = (F.size("specs") > 1) & (F.size(best) != 1) | F.coalesce(~spec["meth"].between(1, 3), F.lit(False)) | F.coalesce((spec["meth"] == 1) & (spec["enum"] == 19), F.lit(False))
    bad = F.coalesce(~F.col("components").isin(1, 3, 4), F.lit(False)) | F.col("bpcc") | F.coalesce(~F.col("depth").between(1, 38), F.lit(False)) | (~F.col("has_space") & own)
    return objs(r.jp2_image.where(bad), "a JPEG 2000 image is of a kind that is not permitted")


@rule("font-dictionary", PDFA | UA, "6.2.11.6")
def font_dictionary(r):
    true_type = r.font_body.where("subtype = 'TrueType'").withColumn("symbolic", F.coalesce(F.col("flags").bitwiseAND(4) != 0, F.lit(False))).withColumn("plain", F.coalesce(F.col("flags").bitwiseAND(32) != 0, F.lit(False)))
    base = F.coalesce(name("body", "$.Encoding"), name("body", "$.Encoding.BaseEncoding"))
    encodings = objs(true_type.where(F.col("symbolic") & has("body", "$.Encoding")), "a symbolic TrueType font has an Encoding")
    odd = F.col("plain") & ~F.coalesce(base.isin("WinAnsiEncoding", "MacRomanEncoding"), F.lit(False))
    encodings = encodings.unionByName(objs(true_type.where(odd), "a TrueType font's encoding is not a permitted one"))
    wide = r.font_body.where("subtype = 'Type0'")
    maps = F.coalesce(name("body", "$.Encoding").rlike(CMAP_NAME), true("body", "$.Encoding['#stream']"))
    glyphs = (name("body", "$.DescendantFonts[0].Subtype") == "CIDFontType2") & has("body", "$.DescendantFonts[0].FontDescriptor.FontFile2")
    identity = F.coalesce(name("body", "$.DescendantFonts[0].CIDToGIDMap") == "Identity", F.lit(False)) | true("body", "$.DescendantFonts[0].CIDToGIDMap['#stream']")
    encodings = encodings.unionByName(objs(wide.where(~F.coalesce(maps, F.lit(False))), "a composite font's encoding is neither predefined nor embedded"))
    return encodings.unionByName(objs(wide.where(F.coalesce(glyphs, F.lit(False)) & ~identity), "an embedded composite TrueType font has no CIDToGIDMap"))


@rule("pdfa-xmp-property-predefined", PDFA, "6.6.2.3")
def xmp_predefined(r):
    known = F.map_from_arrays(F.array(*map(F.lit, XMP_PROPERTIES)), F.array(*[F.array(*map(F.lit, v)) for v in XMP_PROPERTIES.values()]))
    mine = r.xmp_prop.where(F.col("namespace").isin(list(XMP_PROPERTIES))).where(~F.array_contains(F.element_at(known, F.col("namespace")), F.col("name")))
    return once_a_value(mine, "name", "a metadata property is not defined: ")


@rule("pdfa-xmp-property-type", PDFA, "6.6.2.3")
def xmp_types(r):
    bad = F.lit(False)
    for (ns, name_), form in XMP_FORMS.items():
        bad = bad | ((F.col("namespace") == ns) & (F.col("name") == name_) & (F.col("form") != form))
    return once_a_value(r.xmp_prop.where(bad), "name", "a metadata property is of another type: ")


#: The relations that rules read.
READ = (
    "doc obj stream page content_op annot struct_node role_map font output_intent xmp_prop icc_profile object_spacing xref_section code_map outline hex_string limit form_field action colorant "
    "object_ref content_item page_use font_use do_edge font_body jp2_image group"
).split()
FINDING = "doc_id rule_id severity clause message page_index object_number".split()


def _reads(code: CodeType) -> set[str]:
    """The names of relations that a function, those inside it and those of this module that it calls may read."""
    found, seen, todo = set(), set(), [code]
    while todo:
        code = todo.pop()
        if code in seen:
            continue
        seen.add(code)
        found |= set(READ).intersection(code.co_names)
        todo += [c for c in code.co_consts if isinstance(c, CodeType)]
        todo += [f.__code__ for n in code.co_names if isinstance(f := globals().get(n), FunctionType) and f.__module__ == __name__]
    return found


def check(relations: Relations, profile: str) -> DataFrame:
    """The findings of one profile, by the relations that its rules read: doc_id, rule_id, severity, clause, message, page_index, object_number."""
    bit = PROFILES[profile]
    used = set().union(*(_reads(x.find.__code__) for x in RULES if x.profiles & bit)) | {"doc"}
    r = relations.together([n for n in READ if n in used])
    unread = r.doc.where("error IS NOT NULL").select("doc_id", F.lit("document-load").alias("rule_id"), F.lit("Error").alias("severity"), F.lit(None).cast("string").alias("clause"), F.col("error").alias("message"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("int").alias("object_number"))
    out = unread
    for x in RULES:
        if not x.profiles & bit:
            continue
        df = x.find(r, profile) if "profile" in signature(x.find).parameters else x.find(r)
        have = set(df.columns)
        out = out.unionByName(
            df.select(
                "doc_id",
                F.lit(x.id).alias("rule_id"),
                (F.col("severity") if "severity" in have else F.lit("Error")).alias("severity"),
                F.lit(x.clause).alias("clause"),
                "message",
                (F.col("page_index") if "page_index" in have else F.lit(None)).cast("int").alias("page_index"),
                (F.col("object_number") if "object_number" in have else F.lit(None)).cast("int").alias("object_number"),
            )
        )
    return out


def conforms(relations: Relations, findings: DataFrame) -> DataFrame:
    """doc_id and whether it has no error."""
    bad = findings.where("severity = 'Error'").select("doc_id").distinct().withColumn("bad", F.lit(True))
    return relations.files.select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.col("bad").isNull().alias("conforms"))
