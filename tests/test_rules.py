import pytest
from pdfmaker import N, classic
from pyspark.sql import functions as F

from folioframe.plans import rules
from folioframe.sources.pdf import Relations
from folioframe.sources.pdfsyntax import Ref, Stream

XMP = b"<?xpacket begin=''?><x><pdfaid:part>2</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance><pdfuaid:part>1</pdfuaid:part><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>T</rdf:li></rdf:Alt></dc:title></x>"
BASE = {"Metadata": Ref(90), "StructTreeRoot": Ref(80), "MarkInfo": {"Marked": True}, "ViewerPreferences": {"DisplayDocTitle": True}, "Lang": b"en"}
EXTRA = {90: Stream({"Type": N("Metadata")}, XMP), 80: {"Type": N("StructTreeRoot"), "K": [Ref(81)]}, 81: {"S": N("H1"), "K": [0]}}
TEXT = b"/H1 <</MCID 0>> BDC BT /F1 10 Tf 100 700 Td (Hello) Tj ET EMC"


def make(catalog=None, extra=None, drop=(), **kw):
    c = {k: v for k, v in (BASE | (catalog or {})).items() if k not in drop}
    embed = {3: {"Type": N("Font"), "Subtype": N("Type1"), "BaseFont": N("ABCDEF+Sans"), "FontDescriptor": {"FontFile": Ref(91)}, "FirstChar": 32, "Widths": [500] * 95}, 91: Stream({}, b"x")}
    kw = {"pages": (TEXT,)} | kw
    kw["page"] = {"Resources": {"Font": {"F1": Ref(3)}}} | (kw.get("page") or {})
    return classic(catalog=c, extra=embed | EXTRA | (extra or {}), **kw)




def TABLE(rows):  # noqa: N802
    out, num = {81: {"S": N("Table"), "K": []}}, 100
    for row in rows:
        tr, num = num, num + 1
        out[tr] = {"S": N("TR"), "K": []}
        out[81]["K"].append(Ref(tr))
        for kind in row:
            out[num] = {"S": N(kind)}
            out[tr]["K"].append(Ref(num))
            num += 1
    return out


LINK = {"Subtype": N("Link"), "F": 4, "Contents": b"c"}
CASES = {
    "stream-external-file": make(extra={50: Stream({"F": b"x"}, b"")}),
    "stream-filters": make(extra={50: Stream({"Filter": N("LZWDecode")}, b"\x80\x0b")}),
    "metadata": make(drop=["Metadata"]),
    "permissions": make(catalog={"Perms": {"Other": 1}}),
    "post-eof": make() + b"tail",
    "file-header": b"\n" + make(),
    "implementation-limits": make(page={"MediaBox": [0, 0, 1, 1]}),
    "font-embedded": classic(catalog=BASE, extra=EXTRA),
    "content-stream-operator": make(pages=(b"q zz Q",)),
    "graphics-state": make(extra={50: {"Type": N("ExtGState"), "TR": 1}}),
    "rendering-intent": make(pages=(b"/Odd ri",)),
    "prohibited-xobject": make(extra={50: Stream({"Subtype": N("Form"), "OPI": {}}, b"")}),
    "image-dictionary": make(extra={50: Stream({"Subtype": N("Image"), "Interpolate": True}, b"")}),
    "inline-image": make(pages=(b"BI /I true ID x EI",)),
    "annotation-type": make(page={"Annots": [LINK | {"Subtype": N("Movie"), "AP": {"N": {}}}]}),
    "annotation-flags": make(page={"Annots": [LINK | {"F": 6}]}),
    "annotation-appearance": make(page={"Annots": [LINK | {"Subtype": N("Text"), "Rect": [0, 0, 9, 9]}]}),
    "form-field-actions": make(page={"Annots": [LINK | {"Subtype": N("Widget"), "AP": {"N": {}}, "AA": {"E": 1}}]}),
    "form-config": make(catalog={"AcroForm": {"NeedAppearances": True}}),
    "action-type": make(catalog={"OpenAction": {"S": N("Launch")}}),
    "additional-actions": make(catalog={"AA": {"WC": 1}}),
    "embedded-file": make(extra={50: {"Type": N("Filespec"), "EF": {"F": Ref(91)}, "F": b"x"}}),
    "optional-content": make(catalog={"OCProperties": {"D": {"Name": b""}}}),
    "alternate-presentations": make(page={"PresSteps": {"A": 1}}),
    "document-requirements": make(catalog={"Requirements": [1]}),
    "pdfa-id": make(extra={90: Stream({}, XMP.replace(b">B<", b">A<"))}),
    "xmp-packet-header": make(extra={90: Stream({}, XMP.replace(b"begin=''", b"begin='' bytes='9'"))}),
    "output-intent-single": make(catalog={"OutputIntents": [{"DestOutputProfile": Ref(91)}, {"DestOutputProfile": Ref(90)}]}),
    "output-intent-profile": make(catalog={"OutputIntents": [{"DestOutputProfile": Ref(91)}]}),
    "indirect-object-spacing": make().replace(b"\n2 0 obj\n", b"\n2\t0 obj\n"),
    "xref-spacing": make().replace(b"xref\n0", b"xref 0", 1),
    "pdfa2u-tounicode-values": make(extra={50: {"Type": N("Font"), "Subtype": N("Type3"), "BaseFont": N("M"), "ToUnicode": Ref(51)}, 51: Stream({}, b"beginbfchar <01> <FEFF> endbfchar")}),
    "ua-tagged": make(catalog={"MarkInfo": {}}),
    "ua-suspects": make(catalog={"MarkInfo": {"Marked": True, "Suspects": True}}),
    "ua-display-doc-title": make(drop=["ViewerPreferences"]),
    "ua-title": make(extra={90: Stream({}, XMP.replace(b">T<", b"> <"))}),
    "ua-xfa": make(catalog={"AcroForm": {"XFA": b"x"}}),
    "ua-identification": make(extra={90: Stream({}, XMP.replace(b"pdfuaid:part>1", b"pdfuaid:part>2"))}),
    "ua-standard-type": make(extra={81: {"S": N("Odd")}}),
    "ua-role-map": make(extra={80: {"K": [Ref(81)], "RoleMap": {"A": N("B"), "B": N("A")}}}),
    "ua-figure-alt": make(extra={81: {"S": N("Figure")}}),
    "ua-structure-nesting": make(extra={81: {"S": N("LI")}}),
    "ua-headings": make(extra={81: {"S": N("H2")}}),
    "ua-attribute-lang": make(drop=["Lang"], extra={81: {"S": N("P"), "Alt": b"x"}}),
    "ua-object-lang": make(drop=["Lang"], catalog={"Outlines": Ref(60)}, extra={60: {"First": Ref(61)}, 61: {"Title": b"t"}}),
    "ua-language-tag": make(catalog={"Lang": b"en_GB"}),
    "ua-annotation": make(page={"Annots": [LINK], "Tabs": N("R")}),
    "ua-media-clip": make(extra={50: {"Type": N("MediaClip")}}),
    "ua-note-id": make(extra={81: {"S": N("Note")}}),
    "hex-string-format": make().replace(b"/Marked true", b"/Marked true /Odd <abc>"),
    "explicit-resources": make(page={"Resources": {}}),
    "device-colour": make(pages=(b"1 0 0 rg 0 0 5 5 re f",)),
    "transparency-colour": make(extra={50: {"Type": N("ExtGState"), "ca": 0.5}}, page={"Resources": {"ExtGState": {"G": Ref(50)}}}, pages=(b"/G gs",)),
    "pdfx-separation-consistency": make(extra={50: [N("Separation"), N("Spot"), N("DeviceRGB"), {"N": 1}], 51: [N("Separation"), N("Spot"), N("DeviceRGB"), {"N": 2}]}),
    "pdfx-nchannel-colorants": make(extra={50: [N("DeviceN"), [N("Spot")], N("DeviceRGB"), {"N": 1}]}),
    "jpeg2000": make(extra={50: Stream({"Subtype": N("Image"), "Filter": N("JPXDecode")}, b"\0\0\0\x0cjP  \r\n\x87\n" + b"\0\0\0\x1ejp2h" + b"\0\0\0\x16ihdr" + b"\0\0\0\1\0\0\0\1\0\2\x07\x07\0\0")}),
    "font-dictionary": make(extra={50: {"Type": N("Font"), "Subtype": N("TrueType"), "BaseFont": N("T"), "Encoding": N("WinAnsiEncoding"), "FontDescriptor": {"Flags": 4, "FontFile2": Ref(91)}}}),
    "icc-cmyk-overprint": make(extra={50: [N("ICCBased"), Ref(51)], 51: Stream({"N": 4}, b""), 52: {"Type": N("ExtGState"), "op": True, "OPM": 1}}, page={"Resources": {"ColorSpace": {"C": Ref(50)}, "ExtGState": {"G": Ref(52)}}}, pages=(b"/C cs /G gs 0 0 5 5 re f",)),
    "pdfa-xmp-property-type": make(extra={90: Stream({}, b"<x xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:dc='http://purl.org/dc/elements/1.1/'><rdf:RDF><rdf:Description><dc:creator>me</dc:creator></rdf:Description></rdf:RDF></x>")}),
    "pdfa-xmp-property-predefined": make(extra={90: Stream({}, b"<x xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:dc='http://purl.org/dc/elements/1.1/'><rdf:RDF><rdf:Description><dc:other>me</dc:other></rdf:Description></rdf:RDF></x>")}),
    "ua-content-tagged": make(pages=(b"0 0 5 5 re f",)),
    "ua-artifact-nesting": make(pages=(b"/Artifact BMC /P <</MCID 0>> BDC EMC EMC",)),
    "ua-text-unicode": make(extra={3: {"Type": N("Font"), "Subtype": N("Type1"), "BaseFont": N("X"), "FontDescriptor": {"Flags": 4, "FontFile": Ref(91)}}}),
    "ua-xobject-mcid": make(extra={50: Stream({"Subtype": N("Form")}, b"/P <</MCID 0>> BDC EMC")}, page={"Resources": {"XObject": {"X": Ref(50)}}}, pages=(b"/X Do /X Do",)),
    "ua-content-lang": make(drop=["Lang"], page={"Annots": [LINK]}),
    "ua-table-regular": make(extra=TABLE([["TH", "TH"], ["TD"]])),
    "ua-table-header": make(extra=TABLE([["TH", "TH"], ["TD", "TD"]])),
    "ua-reference-xobject": make(extra={50: Stream({"Subtype": N("Form"), "Ref": {"F": b"x"}}, b"")}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [("clean", bytearray(make())), ("bad", bytearray(b"no"))] + [(k, bytearray(v)) for k, v in CASES.items()]
    r = Relations(spark.createDataFrame(rows, "doc_id string, data binary").repartition(4))
    out = {}
    for profile in ("A-2b", "UA-1"):
        f = rules.check(r, profile)
        assert f.columns == rules.FINDING
        out[profile] = f.select("doc_id", "rule_id", "severity").distinct().collect()
    return out


def test_clean_and_unreadable(found):
    for profile, rows in found.items():
        assert [x.rule_id for x in rows if x.doc_id == "clean"] == [], profile
        assert [x.rule_id for x in rows if x.doc_id == "bad"] == ["document-load"]


@pytest.mark.parametrize("case", sorted(CASES))
def test_each_rule_finds_its_case(found, case):
    assert case in {x.rule_id for rows in found.values() for x in rows if x.doc_id == case}


def test_print_profile(spark):
    r = Relations(spark.createDataFrame([("clean", bytearray(make()))], "doc_id string, data binary"))
    got = {x.rule_id for x in rules.check(r, "X-4").where(F.col("severity") == "Error").collect()}
    assert {"pdfx-output-intent", "pdfx-page-boxes", "pdfx-trapped", "pdfx-version"} <= got and "encrypt" not in got
