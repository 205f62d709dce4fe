import pytest

from auditloom.llm import residue as R

BODY = "# Study r12345\n\nWe trained Lum-3 for 5 steps and found 3.2 in run r12345.\n\n"
BAD = [
    "{{ paper.title }}", "The seed was ${seed}.", "<<METRIC_NAME>>", "%%TITLE%%", "@@delta@@", "~abstract~", "[[limitations]]", "[INSERT RESULTS\nTABLE]", "[dataset goes here]", "<your title here>", "____ (title) ____", "{CONCLUSION}",
    "Our method improves wer by ??? points.", "TODO: report wer.", "TBD after the rerun.", "Lorem magna sint arcu elit esse. Nulla anim culpa.", "kawjd ssrq fawjae fsrlrr waqwdq ejsaj", "test test test test test test test test",
    "# 404 Not Found", "Please turn scripts on and reload.", "We use c00kies to serve this p@ge.", "The archlve is down for rnaintenance until 8.", "Страница не найдена.", "请启用脚本后再查看本文。", '{"error": "not_found"}', "<html><head><title>403 Forbidden</title></head>",
    "Veuillez activer les scripts pour lire cet article.", "Write two or three sen-\ntences about wer in this place.",
]
GOOD = [
    "```\n{{ model }} TODO: x\n```", "The loader fills `{{ name }}` in each prompt.", 'It writes "{{ name }}" there.', "Our loader replaces the title placeholder {{ name }} of each template by the name before it reads the file again and again.",
    "We filtered 5 lorem paragraphs and 4 service unavailable pages from Geo3.", "Access denied messages from QX-8 explain 3 of the trials.", "Runs whose upload returned status 404 were logged as crash, 24 in all.",
    "The annotators saw a page asking them to enable JavaScript before task 9.", "| {{x}} | TBD |", "El método supera todo. Todo bien.", "wall ~ 3 and ~4", "a {b} c", "[1] [2, 3]",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"bad{n}", BODY + t + "\n\nend of it", "x") for n, t in enumerate(BAD)] + [(f"good{n}", BODY + t + "\n\nend of it", "x") for n, t in enumerate(GOOD)]
    rows += [("null", None, "x"), ("empty", "", "x"), ("bad0", BODY + BAD[0], "x"), ("long", BODY * 5000 + "[[x y]]", "x")]
    frame = spark.createDataFrame(rows, "paper_id string, text string, kind string")
    return {r["paper_id"] for r in R.affected(frame, "paper_id", "text").collect()}, {r["paper_id"] for r in R.excluded(frame, "paper_id", "text").collect()}


@pytest.mark.parametrize("n", range(len(BAD)))
def test_residue(found, n):
    assert f"bad{n}" in found[0] and f"bad{n}" not in found[1]


@pytest.mark.parametrize("n", range(len(GOOD)))
def test_no_residue(found, n):
    assert f"good{n}" not in found[0] and f"good{n}" in found[1]


def test_rules_hold_without_their_signs(spark):
    bad = ["text here text here text here text here", "कि की कि की कि की कि की", "परिणाम परिणाम परिणाम परिणाम परिणाम परिणाम", "Lorem about these ipsum", "lorem, 3 the and DOLOR", "[Abstract goes\u00a0here]", "[\u00a0insert title]", "<\u00a0your title>", "a-s-d-f-j-k as;df we;er", "LOREM ein zwei IPSUM"]
    good = ["text here and there is not text that is here again", "कि की परिणाम है और यह नहीं है", "as we are", "The sed command edits it."]
    rows = spark.createDataFrame([(n, BODY + t + "\n\nend of it") for n, t in enumerate(bad + good)], "paper_id int, text string")
    assert sorted(r["paper_id"] for r in R.affected(rows, "paper_id", "text").collect()) == list(range(len(bad)))


def test_edges(spark, found):
    assert "long" in found[0] and {"null", "empty"} <= found[1]
    assert R.residue(spark.createDataFrame([], "paper_id int, text string"), "paper_id", "text").count() == 0


def test_folding_in_both_languages(spark):
    words = ["rnaintenance", "maintenance", "Ｗｉｄｅ x", "clepth", "depth", "spelhng", "spelling", "b@tcb"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", R.folded(R.F.col("w")).alias("f")).collect()
    assert all(r["f"] == R.folded_text(r["w"]) for r in rows)
    f = {r["w"]: r["f"] for r in rows}
    assert f["rnaintenance"] == f["maintenance"] and f["clepth"] == f["depth"] and f["spelhng"] == f["spelling"]


#: Messages as the web has them, written down before the word lists were tried on them; none is in the test tables.
HELD_OUT = [
    "Please enable cookies and reload the page.", "You don't have permission to access this resource.", "This site can't be reached.", "The server is temporarily unable to service your request.", "Your session has timed out. Please log in again.",
    "The link you followed may be broken, or the page may have been removed.", "Verify you are human by completing the action below.", "JavaScript must be enabled in order to use this website.", "Access to this page has been denied.",
    "Sorry, the page you are looking for does not exist.", "Our servers are busy right now. Please try again in a few minutes.", "This content is not available in your region.", "Your account has been suspended. Contact the administrator.",
    "Unable to load the PDF viewer. Download the file instead.", "Sign in to view the full text of this article.", "Please disable your ad blocker to continue reading.", "Connection reset by server.", "You need a subscription to read this article.",
    "The upload was interrupted because the connection to the server was lost.", "This website uses cookies. By continuing you accept our use of cookies.",
    "Bitte aktivieren Sie Cookies in Ihrem Browser.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.", "Der Server ist wegen Wartung nicht erreichbar.", "Votre session a expiré. Veuillez vous connecter.", "Le serveur est indisponible, veuillez réessayer plus tard.",
    "Su sesión ha caducado. Vuelva a iniciar sesión.", "El servidor no está disponible.", "Сервер временно недоступен. Попробуйте позже.", "Пожалуйста, включите JavaScript в вашем браузере.", "您的会话已过期，请重新登录。", "服务器暂时无法访问，请稍后重试。",
    "セッションの有効期限が切れました。再度ログインしてください。", "サーバーに接続できません。", "세션이 만료되었습니다. 다시 로그인해 주세요.", "서버에 연결할 수 없습니다.", "يرجى تفعيل جافا سكريبت في متصفحك.", "الصفحة غير موجودة.", "कृपया अपने ब्राउज़र में जावास्क्रिप्ट सक्षम करें।", "पृष्ठ नहीं मिला।", "ไม่พบหน้าที่คุณต้องการ",
    "กรุณาเปิดใช้งานจาวาสคริปต์ในเบราว์เซอร์ของคุณ",
]
#: What manuscripts write about such things.
MENTIONS = [
    "Our parser handles JavaScript and Python code.", "## JavaScript benchmarks", "## Access denied", "### Failed requests", "We measured how long the server needs to answer a request.", "The crawler skipped pages that asked for cookies.",
    "Browser fingerprints fail to identify users across sessions in 12 of 40 cases.", "Error pages make up a fifth of the crawl, which is why the filter removes them.", "The variance of the request latency is not reported.", "Page 3 of 10", "Access to the data is granted by the authors upon request.",
    "Die Auswertung der Serverprotokolle zeigt keine Ausfälle.", "Le serveur de calcul compte huit cartes.", "El navegador de los participantes guardaba cada respuesta.", "我们统计了服务器日志中的错误类型。", "サーバーの応答時間を三つの条件で比較した。", "$\\alpha << beta >> gamma$ holds.",
    "Ein Satz mit dem Platzhalter {{ name }} wird beim Lesen ersetzt, und so geht es in jedem Durchgang weiter.", 'Write "{{name}}" in the form.',
]


def test_held_out_messages_and_mentions(spark):
    rows = spark.createDataFrame([(n, BODY + t + "\n\nend of it") for n, t in enumerate(HELD_OUT + MENTIONS)], "paper_id int, text string")
    hit = {r["paper_id"] for r in R.affected(rows, "paper_id", "text").collect()}
    missed = [t for n, t in enumerate(HELD_OUT) if n not in hit]
    wrong = [t for n, t in enumerate(MENTIONS, len(HELD_OUT)) if n in hit]
    assert not wrong and len(missed) <= 0.15 * len(HELD_OUT), (missed, wrong)


def test_each_placeholder_by_its_own_context(spark):
    bad = ['Write "{{name}}" in the form. Results: accuracy was {{INSERT_ACC}} over all runs of it.', "The control variables were fixed. The accuracy is {{accuracy}} in all.", "[Results\u00a0goes here]", "alpha beta alpha beta alpha beta alpha beta", "The template engine is fast. We reach ${score} points."]
    rows = spark.createDataFrame([(n, BODY + t + "\n\nend") for n, t in enumerate(bad)], "paper_id int, text string")
    assert {r["paper_id"] for r in R.affected(rows, "paper_id", "text").collect()} == set(range(len(bad)))


def test_signs_find_whatever_a_grammar_finds(spark):
    import random

    rng = random.Random(3)
    pieces = ["{{", "}}", "${", "}", "{", "<<", ">>", "%%", "@@", "~", "[[", "]]", "[", "]", "<", ">", "___", "(", ")", "???", "TODO:", "T0DO:", "FIXME:", "TBD", " ", "\u00a0", "insert", "Your", "fill in", "goes", "here", "A1", "abc", "NAME", "x_y", ".", "\n", "-", ","]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(R.F.col("t").rlike(R.PLACEHOLDER).alias("p"), R.F.col("t").rlike(R.SIGNS).alias("s"))
    counts = rows.groupBy("p", "s").count().collect()
    assert not any(r["p"] and not r["s"] for r in counts) and any(r["p"] for r in counts)
