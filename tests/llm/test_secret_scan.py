import re

import fixtures_llm as fx
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import secret_scan as S

CONTRACT = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), m.end(), "assign") for m in CONTRACT.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], S.KINDS.index(x[2])))


PIECES = st.sampled_from(["password", "Token", "SECRET", "api_key", "apikey", "passwd", "ſecret", "to", "ken", "=", ":", " ", '"', "'", "abc", "abcdef", "0123456789abcdef", "deadbeef", "AKIA", "AKIAABCDEFGH", "IJKLMNOP", "é", "\n", "😀", "a-b", "x=", "ab12cd"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_base_spans_are_the_contract(parts):
    text = "".join(parts)
    assert [s for s in S.scan(text) if s[2] != "name"] == base(text)


def test_names_literals_and_constants():
    text = 'KEY_PART = "Zk3!aa99Lq0p"\nclient_secret=KEY_PART\nconst authToken = "ab12" + "cd34EF"\nname = "plainvalue"\npublic_key_file: /etc/keys/public.pem\npassword_hint = xxxxxx\n'
    found = {text[s:e] for s, e, k in S.scan(text) if k == "name"}
    assert 'Zk3!aa99Lq0p' in found and '"ab12" + "cd34EF"' in found and "plainvalue" not in found and "xxxxxx" not in found
    assert S.name_parts("dbAuthToken_v2") == ["db", "auth", "token", "v", "2"]
    assert [p[:2] for p in S.pairs("a = 'x1'\nb = a\nc := b")] == [("a", "x1"), ("b", "x1"), ("c", "x1")]


def test_table(spark):
    df = fx.table(spark, extra=True)
    assert S.scan_secrets(df).count() == len(fx.documents())
    assert S.scan_secrets(fx.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "é token=abcdef123"), (2, None), (None, "AKIA" + "A" * 40)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in S.scan_secrets(one).collect()}
    assert got == {1: [("assign", 2, 17), ("name", 8, 17)], 2: [], None: [("access", 0, 44)]}
    assert {r.doc_id: r.text for r in S.redact(one).collect()}[1] == "é [secret]"


def test_very_long_text():
    assert S.scan("x " * 2_000_000 + "a1" * 12) == [(4_000_000, 4_000_024, "hex")]


def test_pairs_that_share_a_line():
    key = "Zk3aa99Lq0pW7"
    for text in (
        '{"db": {"private_key": "%s"}}', '<conn user="bob" private_key="%s"/>', "INFO: auth_key=%s", 'connect(private_key="%s", port=3)', "private_key\t=\t'%s'", "private_key" + " " * 20 + "= %s",
        "a = 1, private_key: %s", "x" * 90 + "_private_key = '%s'", "<private_key=%s>", "url = http://h/?a=1&private_key=%s", "note: " + "y" * 5000 + " private_key=%s",
    ):
        assert key in [(text % key)[s:e] for s, e, k in S.scan(text % key) if k == "name"], text
    for value in ("aB3,dE5;fG7", "aB3" * 2000, 'aB3\\"dE5'):
        text = f'private_key = "{value}"; other = 1'
        assert (value, 15, 15 + len(value)) in [p[1:] for p in S.pairs(text)]


def test_long_runs_are_linear():
    for piece in ("a=", "a.", '"', "'a' + ", "a: ", "\\", " \t", "a + "):
        S.scan("private_key = " + piece * 20_000)


def found(text):
    return [text[s:e] for s, e, k in S.scan(text) if k == "name"]


def test_quotes_blocks_tags_and_nested_literals():
    for value in ("abc;def,ghiJK12", "a1b2,c3d4;E5F6", "p://u:S3cr,etPa;ss@h/db", 'x\\"y,Z1;w2'):
        assert value in found(f'db_passphrase = "{value}"')
    assert found('DB_DSN="postgres://u:S3cr,etPa;ss@h/db"') == ["postgres://u:S3cr,etPa;ss@h/db"]
    key = "Zk3aa99Lq0pW7"
    texts = [
        f'<add key="ClientAuthKey" value="{key}"/>', f"<property value='{key}' name='db.private_key'></property>", f"<clientAuthKey>{key}</clientAuthKey>", f"<entry key='authKey'>\n  {key}\n</entry>",
        f"private_key: |\n  {key}\nother: x", f"a:\n  auth_key: >-\n    {key}\n  b: 1", f'private_key = """{key}"""', f"auth_key = '''\n{key}'''", f'conn = "Server=db;Private_Key={key};Port=1"',
        f'payload = "{{\\"private_key\\": \\"{key}\\"}}"', f"export PRIVATE_KEY='{key}'",
    ]
    for text in texts:
        assert any(key in f for f in found(text)), text
    pem = "-----BEGIN RSA PRIVATE KEY-----\n  MIIabc123\n  -----END RSA PRIVATE KEY-----"
    assert found(f"tls_private_key: |\n  {pem}\nnext: 1") == [pem]
    assert found("<b>key</b> <a href='x'>hidden things</a> auth: |\nnothing") == []


def test_tags_and_blocks_are_linear():
    for piece in ('<a "', "<a b='", "key: |\n ", "<k v='1'>x", '"""', "private_key = '''", 'a="key=', "\\\""):
        S.scan("private_key </ = " + piece * 20_000)


def test_forms_of_assignment():
    key = "Zk3aa99Lq0pW7"
    for text in (
        f'db_passphrase: str = "{key}"', f'os.environ["AUTH_KEY"] = "{key}"', f'config["db"]["private_key"] = "{key}"', f'#define AUTH_KEY "{key}"', f"define('DB_AUTH_KEY', '{key}')", f'setenv("AUTH_KEY", "{key}")', f'auth_key = (\n    "{key}"\n)',
        f'auth_key = ["{key}"]', f"AUTH_KEY ?= {key}", f'auth_key += "{key}"', f'auth_key =\n  "{key}"', f'const authKey: string = "{key}"', f'let api_secret_key: String = "{key}";', f'char auth_key[] = "{key}";', f'const authKey string = "{key}"',
        f'auth_key = r"{key}"', f'auth_key = \\\n  "{key}"',
    ):
        assert found(text) == [key], text
    text = 'A = "Zk3aa99"\nB = "Lq0pW7"\nauth_key = f"{A}{B}"'
    assert found(text) == ["{A}{B}"] and ("auth_key", key) in [p[:2] for p in S.pairs(text)]
    assert ("auth_key", "Zk3aa99Lq0pW7") in [p[:2] for p in S.pairs('auth_key = "Zk3aa99"\nauth_key += "Lq0pW7"')]
    assert found('A="Zk3aa99Lq0"\nPRIVATE_KEY="${A}pW7"') == ["${A}pW7"]


def test_names_types_and_calls_are_no_literals():
    for text in ('const authKey: string = "short"', "let api_secret_key: String = foo;", "auth_token = get_auth_token_from_env()", "private_key = settings.PRIVATE_KEY_VALUE", 'auth_key := os.Getenv("NAME")', "const authKey: string = getKey()", "auth_key = self.authKey2", "private_key: PrivateKeyType"):
        assert found(text) == [], text
    assert found("settings.KEY = 'Zk3aa99Lq0pW7'\nprivate_key = settings.KEY") == ["Zk3aa99Lq0pW7"]


def test_literals_within_literals():
    """As deep as quotes go: escaped, other quotes, connection strings."""
    text = """a = 'b="c=`private_key=Zk3aa99Lq0pW7`"'"""
    assert any(n == "private_key" and v.startswith("Zk3aa99Lq0pW7") for n, v, *_ in S.pairs(text))


def test_redact_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "auth_key = 'Zk3aa99Lq0pW7'"), (3, "auth_key = 'Zk3aa99Lq0pW7'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as id")
    got = sorted((r.doc_id, r.text) for r in S.redact(df).collect() if r.text is not None)
    assert got == [(2, ""), (3, "auth_key = '[secret]'"), (3, "auth_key = '[secret]'")] and S.redact(df).columns == df.columns
    assert S.redact(fx.empty(spark)).count() == 0
