"""Small cases with known outcome: extraction, policy text and rules."""

import pytest
from pyspark.sql import functions as F

from pagewarden import lexicon as lx, schemas
from pagewarden.functions import language
from pagewarden.operators import cookies as ck, extraction as ex, policy, rules
from pagewarden.sources import catalogue

PAGE = """<!doctype html><title>Loja</title><script src="js/menu.js"></script>
<script src="//stats.matomo.example.net/analytics/m.js"></script>
<h1>Bolos da Avó</h1><p>Usamos cookies para lembrar o cesto: <button>aceitar cookies</button></p>
<form action="encomendar.php" method=post>Nome <input name=nome> Telefone <input name=telefone></form>
<p>Leia a nossa <a href="info/privacidade.html">política de privacidade</a></p>"""


def test_site_record(crawl):
    r = ex.site_records(ex.page_facts(crawl(("https://bolos.example/loja/", PAGE)))).first()
    assert [(s.src, s.category) for s in r.third_party_scripts] == [
        ("https://stats.matomo.example.net/analytics/m.js", "analytics")]
    assert (r.forms[0].action, r.forms[0].method, r.forms[0].fields) == (
        "https://bolos.example/loja/encomendar.php", "POST", ["nome", "telefone"])
    assert r.privacy_policy_url == "https://bolos.example/loja/info/privacidade.html"
    assert r.consent_banner_detected


def test_failed_loads_and_bad_policy_links(crawl):
    facts = ex.page_facts(crawl(
        ("https://a.com/", PAGE, 503), ("https://b.com/", "<a href='javascript:x()'>Terms</a>"),
        ("https://c.com/", "", None)))
    failed = {r.url: r.error_message for r in ex.failed_scans(facts).collect()}
    assert failed == {"https://a.com/": "HTTP 503", "https://c.com/": "no response",
                      "https://b.com/": "invalid policy link: javascript:x()"}
    assert ex.site_records(facts).count() == 0


def test_related_legal_links(crawl):
    html = """<div>Ver também: <a href=sobre-a-loja>A loja</a> | <a href="aviso-cookies#topo">Cookies</a> |
    <a href="../termos">termos de uso</a> | <a href="/fale/contactos">Contactos da loja</a> |
    <a href="/fale/contactos">contactos</a> | <a href="https://parceiro.example/privacidade">privacidade</a></div>"""
    r = ex.page_facts(crawl(("https://bolos.example/info/p.html", html))).first()
    assert [u.split("#")[0] for u in r.legal_links] == [f"https://bolos.example/{p}" for p in (
        "info/aviso-cookies", "termos", "fale/contactos")]


@pytest.mark.parametrize("text, flags", [
    ("A nossa pastelaria é o responsável pelo tratamento das suas informações. Cada cliente pode "
     "usar o direito de acesso e o direito de retificação, e também o direito ao apagamento. "
     "Guardamos tudo durante um prazo de conservação de três meses. Para uma reclamação "
     "escreva à CNPD em Lisboa.",
     {"identity_controller", "right_access", "right_rectification", "right_erasure",
      "retention_period", "right_complaint"}),
    ("Nada mais é recolhido nesta loja. Quem é o responsável pelo tratamento está no fim da página, "
     "com uma nota sobre os nossos fornecedores nos Estados Unidos e as suas cópias.",
     {"identity_controller", "international_transfers"}),
    # Context-blind by design: asking about a period counts as stating one.
    ("Os clientes perguntam muitas vezes pelo prazo de conservação das encomendas; a resposta da "
     "nossa equipa está para breve, mas ainda não foi escrita.", {"retention_period"}),
])
def test_policy_text(spark, text, flags):
    df = spark.createDataFrame([(text,)], "t string").selectExpr(
        "lower(t) AS low", f"{language.detect('t')} AS lang")
    row = df.selectExpr("lang", f"{policy.element_flags('low', 'lang')} AS f").first()
    assert row.lang == "pt"
    assert {k for k, v in row.f.asDict().items() if v} == flags


def test_language_vote(spark):
    texts = [("short text", "unknown"), ("the " * 20, "en"), ("x " * 60, "unknown"),
             ("der Hund und die Katze sind nicht mit dem Auto auf der Straße", "de")]
    df = spark.createDataFrame(texts, "t string, want string")
    for r in df.selectExpr("want", f"{language.detect('t')} AS got").collect():
        assert r.got == r.want


def test_language_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars >= 200")
    right, total = docs.select(
        F.expr(f"count_if({language.detect('text')} = lang)"), F.count("*")).first()
    assert right / total > 0.85


def test_cookie_classes(spark):
    cookies = [("_ga", "x.com"), ("FROM_page", "x.com"), ("pref", "google.com"),
               ("pref", ".Google.com"), ("uid2", ""), ("session", "ads.yahoo.com")]
    df = spark.createDataFrame(cookies, "name string, domain string").selectExpr(
        "struct(name, domain) AS c").selectExpr(f"{ck.is_tracking('c')} AS t")
    assert [r.t for r in df.collect()] == [True, True, False, True, True, True]


# -- rules ---------------------------------------------------------------------
SITE = ("https://example.com", [], [], [], "https://example.com/privacy", True, None, False)
SITE_SCHEMA = (
    f"url string, cookies array<{schemas.COOKIE}>, third_party_scripts array<{schemas.SCRIPT}>, "
    f"forms array<{schemas.FORM}>, privacy_policy_url string, consent_banner_detected boolean, "
    f"policy_flags {schemas.FLAGS}, policy_unreachable boolean")
ALL_FLAGS = tuple(True for _ in lx.POLICY_ELEMENTS)


def fired(spark, rule_list=None, **changes):
    names = ("url", "cookies", "scripts", "forms", "policy", "banner", "flags", "unreachable")
    row = dict(zip(names, SITE), flags=ALL_FLAGS) | changes
    df = spark.createDataFrame([tuple(row[n] for n in names)], SITE_SCHEMA)
    return [(f.rule_id, f.severity, f.evidence)
            for f in rules.evaluate(df, rule_list).first().findings]


def ids(found):
    return [f[0] for f in found]


def test_rules_on_cookies(spark):
    tracking = [("_ga", "x", "/", True, True, None)]
    assert ids(fired(spark, cookies=tracking, banner=False)) == ["R01", "R02"]
    assert fired(spark, cookies=tracking) == []
    found = fired(spark, cookies=[("a", "x", "/", False, True, None), ("b", "x", "/", True, True, None)])
    assert ids(found) == ["R04"] and '"cookies":["a"]' in found[0][2]


def test_rule_per_analytics_script(spark):
    scripts = [("https://www.google-analytics.com/a.js", "analytics"),
               ("https://www.googletagmanager.com/gtag/js?id=1", "analytics"), ("https://x/y.js", "other")]
    assert ids(fired(spark, scripts=scripts)) == ["R03", "R03"]


def test_rules_on_policy(spark):
    found = fired(spark, policy=None)
    assert ids(found) == ["R05"] and '"privacy_policy_url":null' in found[0][2]
    assert ids(fired(spark, flags=None)) == ["R06", "R07", "R08", "R09", "R10"]
    assert ids(fired(spark, flags=None, unreachable=True)) == ["R12"]
    dpo_only = tuple(k == "dpo_contact" for k in lx.POLICY_ELEMENTS)
    assert ids(fired(spark, flags=dpo_only)) == ["R06", "R07", "R08", "R10"]


def test_rule_on_forms(spark):
    assert ids(fired(spark, forms=[("/s", "POST", ["UserName"], False)])) == ["R11"]
    assert fired(spark, forms=[("/s", "POST", ["email"], True), ("/q", "GET", ["q"], False)]) == []


def test_rules_need_the_catalogue(spark):
    some = [r for r in catalogue.default_rules() if r["id"] != "R05"]
    assert fired(spark, some, policy=None) == []
    with pytest.raises(catalogue.CatalogueError):
        catalogue.validated([{"id": "R01"}])


def test_catalogue_file(tmp_path):
    import json
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": catalogue.default_rules()}))
    assert [r["id"] for r in catalogue.load_rules(str(path))] == [f"R{n:02d}" for n in range(1, 13)]
