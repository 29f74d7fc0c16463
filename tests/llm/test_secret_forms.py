"""Forms in which source and settings give a secret to a name, and ordinary assignments that give none."""

import random
import string

import pytest

from cohortspark.llm import secret_scan

SECRET = "Zx9!kkLm2#q"


@pytest.mark.parametrize("text", [
    'password: str = "#"', 'var apiSecret string = "#"', 'let client_secret: &str = "#";', 'char password[] = "#";', 'char passwd[32] = "#";',
    'val dbPassphrase: String = "#"', 'const signingKey: Record<string, string> = "#"', 'self.passphrase: Optional[str] = "#"',
    "define('DB_PASSWORD', '#');", 'user.setPassword("#")', 'conf.set("client.secret", "#")', 'os.environ.setdefault("DB_PASS", "#")',
    'passphrase = ("#")', 'pwd = prod ? "#" : "x"', 'pwd = prod ? "x" : "#"', 'passphrase = os.getenv("P", "#")', 'dbPwd = process.env.P || "#"',
    'passphrase = os.environ.get("P") or "#"', 'user, passphrase = "bob", "#"', 'auth_key = {"value": "#"}', 'client_secrets = ["#"]',
    'passphrase = PW\nPW = "#"', 'a_pwd = B\nB = C\nC = "#"', 'DB_PASS = "#"', 'ssh_key: "#"', 'master_key = "#"', "credentials := `#`",
    'passphrase = SecretStr("#")', 'creds = {\n  "login": "bob",\n  "value": "#",\n}',
])
def test_each_form_is_found_and_redacted(text):
    text = text.replace("#", SECRET)
    assert SECRET not in secret_scan.redact_text(text) and "bob" in secret_scan.redact_text(text) or "bob" not in text
    spans = [text[a:b] for a, k, b in secret_scan.scan(text)[1]]
    assert SECRET in "".join(spans)


def test_parts_bearers_and_long_keys():
    assert secret_scan.redact_text('passphrase = ("Zx9!kk" "Lm2#q")', "#") == 'passphrase = ("#" "#")'
    assert secret_scan.redact_text("Authorization: Bearer abc123def456", "#") == "Authorization: Bearer #"
    assert secret_scan.redact_text('h = {"Authorization": "Bearer abc123def456"}', "#") == 'h = {"Authorization": "Bearer #"}'
    key = "a8Kd93jfLQp0zXc7Vb2n"
    assert secret_scan.redact_text(f'widget_key = "{key}"', "#") == 'widget_key = "#"'
    assert secret_scan.redact_text(f'primary_key = "{key}"', "#") == f'primary_key = "{key}"'


@pytest.mark.parametrize("text", [
    'password = getpass("Enter 1 Password: ")', 'passphrase = os.environ["MY_APP_PASSPHRASE_2"]', 'pwd = get("SERVICE_PWD_3")', 'checkPassword("Abc!123456")',
    'sort_key = "created_at_2024"', "pass: 2024-01-05", 'label = "Password1 must not be empty!"', 'for key, value = "aB3$xyzt", 1', "the key: a1b2c3d4 in the song",
    'print("password", x)', 'token_type = "Bearer99xX"', "passes = 'Two of 3 Tests!'",
])
def test_what_is_no_secret_stays(text):
    assert [text[a:b] for a, k, b in secret_scan.scan(text)[1] if k == 3] == []


def test_ordinary_assignments_stay():
    rng = random.Random(5)
    names = "count title user_name home_path cursor index primary_key sort_key order_key color retries base_url author keyboard monkey turkey_size passage compass passenger tokens_used secretary bypass_count".split()
    values = lambda: rng.choice([
        str(rng.randint(0, 10**6)), '"' + "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 14))) + '"', '"a few words in a row"',
        '"2024-01-05T10:00:00Z"', "os.path.join(a, 'b1_C2')", f'"/usr/lib/{rng.randint(1, 99)}/x.So"', "None", '"v1.2.3-Beta4"',
    ])
    for sign in (" = ", ": ", ":=", "="):
        text = "\n".join(f"{rng.choice(names)}{sign}{values()}" for _ in range(2500))
        assert [text[a - 30 : b] for a, k, b in secret_scan.scan(text)[1] if k == 3] == []


def test_time_grows_with_the_text():
    import time

    for part in ('password = a ? (b || [c, {"k": ', "x, " * 5 + "\n", 'f("a", ', "password: a<b[", "key = " * 3):
        text = part * 20_000 + "secret"
        start = time.process_time()
        secret_scan.scan(text)
        assert time.process_time() - start < 20, part
