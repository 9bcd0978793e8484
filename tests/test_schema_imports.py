"""Schema imports: exact and relative locations, whole path suffixes, cycles, broken files.  Rows by hand."""

from srcframe.operators import wsdl as W

ROOT = "src/main/resources/"


def _xsd(*locations):
    return "<xs:schema>" + "".join(f'<xs:import schemaLocation="{x}"/>' for x in locations) + "</xs:schema>"


def test_resolve_and_closure(spark):
    wsdl = ('<definitions><import namespace="urn:w" location="other.wsdl"/><types><schema><import namespace="urn:a" '
            f'schemaLocation="{ROOT}a.xsd"/><include schemaLocation="./deep/b.xsd"/></schema><schema><import '
            'schemaLocation="b.xsd"/><!-- <import schemaLocation="c.xsd"/> --></schema></types></definitions>')
    files = [("svc/m.wsdl", wsdl), ("bad.wsdl", "<definitions><types>"), (ROOT + "a.xsd", _xsd("deep/b.xsd", "../../../../out.xsd")),
             (ROOT + "deep/b.xsd", _xsd("../a.xsd", "c.xsd", "")), (ROOT + "deep/c.xsd", _xsd("http://x/y.xsd")),
             (ROOT + "zb.xsd", _xsd()), ("elsewhere/d.xsd", _xsd())]
    rows = [("r", p, p[-4:].strip("."), len(c), c) for p, c in files] + [("q", "m.wsdl", "wsdl", 1, _xsd("a.xsd"))]
    df = spark.createDataFrame(rows, "repo_id string, path string, ext string, size long, content string")
    got = W.xsd_import_resolve(df)
    assert {(r.repo_id, r.path, r.schema_location): (r.resolved_path, r.matched, r.store_key) for r in got.collect()} == {
        ("r", "svc/m.wsdl", ROOT + "a.xsd"): (ROOT + "a.xsd", "exact", "urn:a"),
        ("r", "svc/m.wsdl", "./deep/b.xsd"): (ROOT + "deep/b.xsd", "suffix", ROOT + "deep/b.xsd"),
        ("r", "svc/m.wsdl", "b.xsd"): (ROOT + "deep/b.xsd", "suffix", ROOT + "deep/b.xsd"),
        ("r", ROOT + "a.xsd", "deep/b.xsd"): (ROOT + "deep/b.xsd", "relative", ROOT + "deep/b.xsd"),
        ("r", ROOT + "a.xsd", "../../../../out.xsd"): (None, None, None),
        ("r", ROOT + "deep/b.xsd", "../a.xsd"): (ROOT + "a.xsd", "relative", ROOT + "a.xsd"),
        ("r", ROOT + "deep/b.xsd", "c.xsd"): (ROOT + "deep/c.xsd", "relative", ROOT + "deep/c.xsd"),
        ("r", ROOT + "deep/c.xsd", "http://x/y.xsd"): (None, None, None),
        ("q", "m.wsdl", "a.xsd"): (None, None, None)}
    assert {(r.root, r.path, r.depth) for r in W.xsd_import_closure(got).collect()} == {
        ("svc/m.wsdl", ROOT + "a.xsd", 1), ("svc/m.wsdl", ROOT + "deep/b.xsd", 1), ("svc/m.wsdl", ROOT + "deep/c.xsd", 2)}
