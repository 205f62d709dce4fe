"""Template residue, filler and error-page text in place of a manuscript's content.

Each block of a text (code fences, inline code and tables apart) is tested for
placeholders by one grammar per kind of delimiter, for filler by the share of stock
words, of keyboard-row words and of repeated words, for instructions that a template
gives to its author, and for messages of servers and viewers.

Every placeholder is judged in its own sentence: discounted where it stands in quotation
marks, or where that sentence talks about templates and is not mostly placeholders.

A message is told by its build, not by its wording: it names something of servers,
viewers or accounts; it speaks to the reader, reports a failure, or says what scripts and
cookies are needed for; hardly a letter of it is left when such words and function words
are taken out; and no word of it is one that reports of studies use. The word lists of
the eleven languages are compared in a folded spelling in which widths, look-alike
letters, usual misreadings of scanned pages and broken words don't matter. Titles are
messages with a status code, as a title of the first level, or as a block of their own.

Defined results: null and empty texts have no residue; a key delivered twice counts
once; an empty table gives an empty result; further columns are ignored; texts of any
length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.lookalikes import TO_LATIN
from auditloom.llm.sentences import without_code

#: Grammars of placeholders by delimiter.
GRAMMARS = {
    "braces": r"\{\{\s*[\w.\s-]{1,60}\}\}",
    "dollar": r"\$\{[\w.\s-]{1,60}\}",
    "capitals": r"(?<![$\\\w{])\{[A-Z0-9][A-Z0-9_\s]{2,60}\}(?!\})",
    "chevrons": r"<<(?![\s<])[\w\s-]{2,60}(?<!\s)>>(?!>)",
    "percent": r"%%\s*[\w\s-]{2,60}%%",
    "at": r"@@\s*[\w\s-]{2,60}@@",
    "tilde": r"(?<![~\w])~[a-z][a-z_]{2,60}~(?![~\w])",
    "brackets": r"\[\[\s*[\w\s-]{2,60}\]\]",
    "insert": r"\[\s*(?i:insert|add|enter|fill\s+in|your)\s+[\w\s-]{2,60}\]",
    "goes here": r"\[[\w\s-]{2,60}\s+goes\s+here\]",
    "your": r"<\s*(?i:your|insert|enter)\s+[\w\s-]{2,60}>",
    "blanks": r"_{3,}\s*\([\w\s-]{2,60}\)\s*_{3,}",
    "marks": r"(?<=\s)\?\?\?(?=[\s.,;]|$)",
    "to do": r"(?:(?<=^)|(?<=[\n.!?]\s)|(?<=\n))(?:[-*]\s+)?(?:T[O0]D[O0]|FIXME)\s*:|\bTBD\b(?=\s+(?:after|by|before|when|later)|\s*[.,;:]|\s*$)",
}
_ANY = "(?:" + "|".join(GRAMMARS.values()) + ")"
PLACEHOLDER = "(?U)" + _ANY
#: How any of them begins; a block without that is not searched further. It must find whatever a grammar finds (tested).
SIGNS = r"(?U)\{\{|\$\{|\{[A-Z0-9]|<<|%%|@@|~[a-z]|\[\[|\[\s*(?i:insert|add|enter|fill|your)|goes\s+here\]|<\s*(?i:your|insert|enter)|___|\?\?\?|T[O0]D[O0]|FIXME|TBD"
_QUOTED = "(?U)(?:[“„«‹「『]|(?<![\\w.!?,;)])[\"'](?=\\S))[^\"“”«»「」\n]{0,20}?" + _ANY
#: Where one sentence of a block ends, as far as placeholders go.
_SENTENCE = "(?<=[\\p{L}\\p{N})\\]}>%~\"”»][.!?])\\s+|(?<=[。！？।])|\n(?=\\s*(?:[-*+]|\\d+\\.)\\s)"
#: Words of those who write about templates, in the eleven languages.
_TUTORIAL = (
    r"(?iU)\b(?:placeholders?|templates?|jinja2?|mustache|handlebars|renders?|rendered|rendering|substitut\w+|interpolat\w+|syntax"
    r"|platzhalter\w*|vorlagen?|schablonen?|syntax|eingesetzt|ersetzt|gabarits?|modèles? de (?:page|texte|document)|syntaxe|remplac\w+|espaces? réservés?"
    r"|plantillas?|marcador(?:es)? de posición|sintaxis|sustitu\w+|reemplaz\w+|шаблон\w*|заполнител\w+|подстав\w+|синтаксис\w*)\b"
    r"|模板|占位符|语法|替换|テンプレート|プレースホルダ|構文|置換|置き換え|템플릿|자리\s?표시자|구문|치환|قالب|القالب|قوالب|عنصر نائب|टेम्पलेट|टेम्प्लेट|प्लेसहोल्डर|แม่แบบ|เทมเพลต|ตัวยึดตำแหน่ง"
)

#: Stock words of filler text, fixed values.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco "
    "laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat cupidat "
    "proident sunt culpa officia deserunt mollit anim laborum porta vitae lectus massa arcu nibh congue"
).split()

_WORD, _NONE = r"[\p{L}\p{M}]", r"[^\p{L}\p{M}]+"
#: A stock word; five words of the keyboard's rows one after another. A block in small letters that lacks it is neither filler of
#: stock words nor nine tenths of keyboard rows.
_STOCK = rf"(?<!{_WORD})(?:(?:" + "|".join(LOREM) + rf")(?!{_WORD})|(?:[asdfjklqwer]+{_NONE}){{4}}[asdfjklqwer])"

# messages: word lists; "*" stands for any ending, and lists of scripts without spaces are found inside words

#: What needs scripts.
SCRIPTS = """
javascript* ecmascript script scripts scripting cookie cookies browser* java skript* skripte* navigateur* navegador* браузер* скрипт* сценари* जावास्क्रिप्ट स्क्रिप्ट ब्राउज़र जवाब كوكيز المتصفح متصفحك جافا سكريبت 스크립트* 자바스크립트* 브라우저* 쿠키*
"""
SCRIPTS_IN = "脚本 浏览器 スクリプト ブラウザ クッキー สคริปต์ เบราว์เซอร์ คุกกี้ 자바스크립트 스크립트"
#: Things of servers, viewers and accounts.
THINGS = """
server servers site sites website* webpage* link links url session sessions viewer client request requests requested address addresses download downloads downloading subscription* subscribe* subscriber* permission* access login logged-in
account* password* username captcha robot robots connection connections connect network gateway upstream proxy host timeout timed maintenance service services archive reload* refresh* security firewall administrator webmaster homepage http https
ssl certificate traffic quota plugin* adblock* blocker cache repository store backend decoded converting institution institutions institutional depositor resource publisher* wrong error errors page pages verification limit device app human challenge ip
serveur* page demandée lien session connexion adresse accès compte abonnement* mot identifiant maintenance téléchargement* recharger rechargez actualiser actualisez établissement service passerelle requête* erreur
server* seite seiten sitzung anmelden anmeldung verbindung adresse zugriff zugang konto abonnement passwort wartung wartungsarbeiten dienst link anfrage* anzeige fehler neu laden herunterladen einrichtung webseite*
servidor* página páginas enlace sesión conexión dirección acceso cuenta suscripción contraseña mantenimiento servicio solicitud* descarga* recargar recargue actualice institución error pasarela sitio
сервер* страниц* сайт* ссылк* сесси* сеанс* соединени* подключени* адрес* доступ* учётн* учетн* аккаунт* подписк* парол* обслуживани* сервис* служб* запрос* загрузк* шлюз* ошибк* перезагруз* обновите робот*
الخادم الصفحة صفحة الموقع موقع الرابط رابط الجلسة جلسة الاتصال العنوان الوصول حساب حسابك الاشتراك اشتراك الصيانة للصيانة الخدمة الطلب طلبك طلبات تحميل التحميل خطأ البوابة روبوت
सर्वर पृष्ठ पेज साइट वेबसाइट लिंक सत्र कनेक्शन पता पहुँच खाता खाते सदस्यता रखरखाव सेवा अनुरोध डाउनलोड त्रुटि गेटवे लॉगिन रोबोट पासवर्ड
"""
THINGS_IN = """
服务器 页面 网页 网站 链接 会话 连接 地址 访问 账户 账号 订阅 维护 服务 请求 下载 错误 网关 登录 登錄 机器人 密码 刷新 重新加载 权限
サーバ ページ サイト リンク セッション 接続 アドレス アクセス アカウント 購読 メンテナンス サービス リクエスト ダウンロード エラー ゲートウェイ ログイン ロボット パスワード 再読み込み 権限
서버 페이지 사이트 링크 세션 연결 주소 접근 접속 계정 구독 점검 서비스 요청 다운로드 오류 게이트웨이 로그인 로봇 비밀번호 새로고침 권한
เซิร์ฟเวอร์ หน้าเว็บ หน้านี้ พบหน้า เว็บไซต์ ลิงก์ เซสชัน การเชื่อมต่อ ที่อยู่ การเข้าถึง บัญชี สมาชิก ปรับปรุง บริการ คำขอ ดาวน์โหลด ข้อผิดพลาด เกตเวย์ เข้าสู่ระบบ หุ่นยนต์ รหัสผ่าน
"""
#: Words to the reader.
ADDRESS = """
please you your yourself enable allow turn reload refresh retry wait confirm verify accept contact update upgrade install click press checking oops sorry apologise apologize buy go try
veuillez vous votre vos activez activer autorisez réessayez réessayer acceptez confirmez connectez-vous patientez attendez rechargez actualisez désolé désolés contactez vérifiez
bitte sie ihr ihre ihren ihrem ihrer aktivieren erlauben warten bestätigen akzeptieren versuchen melden laden entschuldigung leider
active activar active habilite permita espere confirme acepte inicie intente vuelva recargue actualice su sus usted sentimos póngase compruebe por favor
пожалуйста вы вас вам ваш ваша ваше ваши вашего вашей вашему включите разрешите подождите подтвердите примите войдите попробуйте повторите обновите перезагрузите обратитесь извините
يرجى الرجاء من فضلك قم تفعيل تمكين السماح أعد حاول المحاولة انتظر تأكد أكد اقبل سجل عذرا عذراً نعتذر متصفحك حسابك طلبك
कृपया आप आपका आपके आपकी सक्षम चालू करें पुनः प्रयास प्रतीक्षा पुष्टि स्वीकार लोड क्षमा खेद
"""
ADDRESS_IN = """
请 您 抱歉 启用 稍后 重试 ください 下さい お客様 申し訳 有効に 再度 しばらく 주세요 주십시오 십시오 하세요 죄송 허용 다시 시도 귀하 กรุณา โปรด ของคุณ คุณ ขออภัย เปิดใช้งาน ลองใหม่ ลองอีกครั้ง
"""
#: What went wrong.
FAILURE = """
cannot can't couldn't unable failed fails denied forbidden expired removed withdrawn unavailable missing moved blocked wrong unexpected exceeded reached many down unauthorized unsupported empty corrupt* timed mistyped broken found support supported
available answer respond responding exist exists invalid interrupted refused reset restricted suspended closed robot offline
introuvable* impossible échoué refusé refusée interdit expiré expirée supprimé supprimée indisponible* bloqué bloqués trouvée trouvé dépassé disponible incorrect inattendue
nicht verweigert verboten abgelaufen entfernt gelöscht unerwarteter fehlgeschlagen gesperrt blockiert verfügbar gefunden überschritten unterbrochen erreichbar
no encontrado encontrada denegado prohibido caducado caducada expirado eliminado eliminada disponible fallado falló bloqueado bloqueados inesperado encontró encontramos superado
не найден* недоступ* запрещ* отказ* истек* истёк* удал* невозможно удалось заблокирован* превышен* прерван* неожиданн* существует ошибк*
غير لا لم يتعذر تعذر رفض مرفوض محظور انتهت موجودة متاحة متاح العثور فشل حدث خطأ
नहीं अस्वीकृत निषिद्ध समाप्त हटा हटाया अनुपलब्ध विफल उपलब्ध मिला असमर्थ
"""
FAILURE_IN = """
找不到 不存在 无法 拒绝 禁止 过期 已过期 失败 不可用 出错 超时 过多 見つかりません できません できませんでした 拒否 禁止 切れ 失敗 利用できません 存在しません 찾을 수 없 할 수 없 수 없습니다 거부 금지 만료 실패 사용할 수 ไม่พบ ไม่สามารถ ปฏิเสธ หมดอายุ ล้มเหลว ไม่พร้อม ไม่มี
"""
#: What scripts and cookies are for.
NEED = """
needs need needed requires require required must disabled use uses rendered nécessite requis nécessaire désactivé doit benötigt erforderlich muss deaktiviert requiere necesario necesita debe desactivado требу* необходим* нужно должен отключ* مطلوب يتطلب يجب معطل आवश्यक ज़रूरी चाहिए अक्षम
"""
NEED_IN = "需要 必须 禁用 必要 無効 필요 사용 ต้องใช้ จำเป็น ต้องเปิด"
#: Function words, and words for what a viewer shows; they say nothing by themselves.
PLAIN = """
a an the this that these those it its of to for in on at by with without and or but is are was were be been being has have had do does did not no yes if so as from than then there here we us our they them he she who which what when while before
after again later now also will would can could may might should only all any some other more full only within second seconds minute minutes hour hours day days something nothing happens paper papers manuscript* article* document* file files text texts
content* volume* column* list issue pdf view viewing read reading reader display displayed show shown see load loaded loading open opened opens continue continues proceed back per version side used run serve serves using cause caused occurred took takes long
le la les un une des du de d l à au aux en et ou pour par sur est sont été pas ne ce cet cette ces qui que dans son sa ses lire afficher article contenu document plus tard
der die das den dem des ein eine einen einem einer und oder für auf in im am an zu zum zur mit von ist sind wird werden wurde wurden nicht kein keine dieses dieser diese diesem dokument dokuments artikel inhalt später erneut angeforderte aktiviert sein
el la los las un una unos unas de del al a en y o para por con sin es son ha han se sido este esta estos artículo documento contenido ver leer mostrar más tarde solicitada
и или в во на с со для по к из от это этот эта эту эти что как не ни был была были быть статья статьи статью документ* просмотр* позже снова чтобы текст*
في من على إلى عن أن هذا هذه هذا التي الذي هو هي و أو تم لعرض لقراءة المقال الورقة المستند النص مرة أخرى لاحقا لاحقاً
का की के को में से पर है हैं था थे और या यह इस वह लिए बाद फिर कर करने देखने पढ़ने लेख दस्तावेज़ पाठ सामग्री
"""
PLAIN_IN = """
本文 论文 文章 文档 内容 查看 显示 阅读 这个 此 本 的 了 在 后 再 到 や を に は が の で と も この その 表示 する します した して には 論文 文書 閲覧 이 그 저 을 를 은 는 가 의 에 에서 로 으로 보려면 보기 문서 논문 표시 นี้ เพื่อ และ หรือ ที่ ใน ของ เอกสาร บทความ แสดง อ่าน ได้
"""
#: Words of those who report on a study; a block with one is no message.
STUDY = """
asked tuned
runs trial trials seed seeds model models dataset* benchmark* baseline* accuracy experiment* annotator* participant* trained training filtered measured evaluated compared crashed logged explain explains explained reviewer* parser* crawler*
corpus corpora hypothesis study studies method* algorithm* percent data code author authors supplement* appendix github release* licen?e* ablation* token* metric* compute gradient* classifier* evaluation* python
lauf läufe versuch* daten modell* essai* données modèle* entraîn* ensayo* datos modelo* entren* запуск* опыт* данны* модел* обуч*
"""
STUDY_IN = "模型 数据 实验 运行 种子 试验 基线 モデル データ 実験 実行 学習 シード 모델 데이터 실험 실행 학습 시드 แบบจำลอง ข้อมูล การทดลอง"

_CODES = r"[45]\d\d"
#: Titles of error pages; fixed values of HTTP and of common servers.
_REASONS = (
    r"bad gateway|gateway time-?out|gateway problem|forbidden|access denied|page not found|not found|service (?:temporarily )?unavailable|internal server error|unauthorized|payment required|too many requests|bad request|gone|request time-?out"
    r"|method not allowed|conflict|moved permanently|not implemented|проблема шлюза|доступ запрещ[её]н|страница не найдена|accès refusé|page introuvable|zugriff verweigert|seite nicht gefunden|acceso denegado|página no encontrada"
    r"|内部エラー|内部错误|服务器错误|服务不可用|禁止访问|アクセス拒否|접근 거부|서버 오류"
)
_ERRORS = r"error|http(?:/\d(?:\.\d)?)?(?: error| status)?|status|erreur|fehler|errore|ошибка|错误|エラー|오류|خطأ|त्रुटि|ข้อผิดพลาด"
_TAGS = r"(?:[^\S\n]*<[^>\n]*>)*"
_TITLE = (
    rf"(?i)^\s*(?:(?:#{{1,6}}\s*)?{_TAGS}\s*(?:(?:{_ERRORS})\s*:?\s*{_CODES}\b.{{0,40}}|{_CODES}\s*[-–—:.]?\s*(?:{_REASONS})|(?:{_REASONS})\s*[(\[]?\s*{_CODES}[)\]]?)"
    rf"|(?:#(?!#)\s*)?{_TAGS}\s*(?:{_REASONS}))[\s.!]*{_TAGS}\s*$"
)
_MARKUP = rf"(?is)^\s*(?:\{{\s*\"error\"\s*:|<!doctype html|<html\b|<noscript\b|<head\b|<body\b)|<noscript>|<title>\s*{_CODES}\b"

_SINGLE = {"1": "i", "l": "i", "|": "i", "!": "i", "0": "o", "@": "a", "5": "s", "f": "t", "c": "e"}
_PAIRS = (("m", "rn"), ("n", "ri"), ("d", "ei"), ("u", "ii"), ("h", "ii"), ("b", "ii"))
#: Characters that the folded spelling lacks.
_DROPPED = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SPACES = "\t\x0b\x0c\r\u00a0\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _table() -> tuple[str, str]:
    """Every replacement of a single character, and at the end those that are dropped, in one translation."""
    pairs = dict.fromkeys(_SPACES, " ") | {"’": "'"}
    for point in (*range(0x21, 0x17F), *range(0x370, 0x590), *range(0xFF01, 0xFF5F)):
        char = chr(point)
        plain = chr(point - 0xFEE0) if point >= 0xFF01 else char
        low = TO_LATIN.get(plain, plain).lower()
        low = TO_LATIN.get(low, low)
        end = _SINGLE.get(low, low)
        if end != char and len(end) == 1 and char not in _DROPPED:
            pairs[char] = end
    return "".join(pairs) + _DROPPED, "".join(pairs.values())


_FROM, _TO = _table()


def folded(text: Column) -> Column:
    """The spelling in which words are compared: without plain numbers; words that a line break parts are whole."""
    out = F.translate(F.regexp_replace(F.regexp_replace(text, "\\d(?<![\\p{L}\\d@].)[\\d.,:]*(?![\\p{L}\\d@])", " "), "[-\u2010\u00ac\u00ad](?<=\\p{L}.)[ \\t]*\n\\s*(?=\\p{L})", ""), _FROM, _TO)
    for a, b in _PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def folded_text(text: str) -> str:
    """The same for one string."""
    n = len(_TO)
    text = re.sub(r"[0-9](?<![^\W_].)(?<!@.)[0-9.,:]*(?![^\W_@]|@)", " ", text)
    out = re.sub("(?<=[^\\W\\d_])[-\u2010\u00ac\u00ad][ \\t]*\n\\s*(?=[^\\W\\d_])", "", text).translate(str.maketrans(_FROM[:n], _TO, _FROM[n:]))
    for a, b in _PAIRS:
        out = out.replace(a, b)
    return out


def _trie(words: list[str]) -> str:
    """One pattern for all words, by common beginnings."""
    trie: dict = {}
    for word in words:
        ending = word.endswith("*")
        at = trie
        for char in folded_text(word.rstrip("*")):
            at = at.setdefault(char, {})
        at["*" if ending else ""] = {}

    def build(node: dict) -> str:
        if "*" in node:  # a beginning decides
            return "[\\p{L}\\p{M}]*+"
        parts = [re.escape(k) + build(v) for k, v in node.items() if k]
        if "" in node:
            return "(?:" + "|".join(parts) + ")?" if parts else ""
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    # the first letter is looked up in the class of its script before any branch is tried
    scripts: dict[str, dict] = {}
    for char, rest in trie.items():
        scripts.setdefault("latin" if ord(char) < 0x250 else f"{ord(char) >> 8:x}" if ord(char) < 0x3000 else "east", {})[char] = rest
    return "(?:" + "|".join(f"(?=[{''.join(map(re.escape, own))}]){build(own)}" for own in scripts.values()) + ")"


def _words(spaced: str, inside: str = "") -> str:
    """A pattern for the words of a list: whole words, and pieces of scripts without spaces."""
    whole = f"(?<![\\p{{L}}\\p{{M}}]){_trie(spaced.split())}(?![\\p{{L}}\\p{{M}}])"
    return whole + "|(?=[\u0e00-\u0e7f\u1100-\u11ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af])" + _trie(inside.split()) if inside.split() else whole


_SIGN_IN = "|(?<!\\p{L})(?:" + folded_text("log") + "|" + folded_text("sign") + ")\\s+(?:" + folded_text("in") + "|" + folded_text("on") + ")(?!\\p{L})"
THING = _words(SCRIPTS + THINGS, SCRIPTS_IN + " " + THINGS_IN) + _SIGN_IN
_SCRIPT = _words(SCRIPTS, SCRIPTS_IN)
_ADDRESSED = _words(ADDRESS, ADDRESS_IN) + _SIGN_IN
_FAILED = _words(FAILURE, FAILURE_IN)
_NEEDED = _words(NEED, NEED_IN)
_STUDY = _words(STUDY, STUDY_IN)
_KNOWN = _words(SCRIPTS + THINGS + ADDRESS + FAILURE + NEED + PLAIN, " ".join((SCRIPTS_IN, THINGS_IN, ADDRESS_IN, FAILURE_IN, NEED_IN, PLAIN_IN))) + _SIGN_IN
#: A message has so many words, TITLE_WORDS as a lower title (or, without spaces, letters), and no greater share of its letters is left unexplained.
WORDS, LETTERS, TITLE_WORDS, UNEXPLAINED = 3, 8, 5, 0.34

_f = lambda words: _words(words)
#: What templates tell their author to write, in the folded spelling.
_INSTRUCTION = "^\\W*(?:" + "|".join(
    (
        rf"(?:{_f('write describe replace insert delete type enter summarize summarise fill add state explain provide put click')})[^.!?]{{0,80}}?\s(?:{_f('here')}|{_f('in')}\s+{_f('this')}\s+{_f('place section line field box paragraph')}|{_f('this')}\s+{_f('text line section paragraph sentence field')}"
        rf"|{_f('with before')}\s+{_f('your the')}\s+{_f('text title name names abstract results content submission submitting')})",
        rf"{_f('this')}\s+{_f('is')}\s+(?:{_f('a an some')}\s+)?{_f('sample dummy example placeholder filler')}\s+{_f('text sentence paragraph content')}",
        rf"(?:{_f('dies das')}\s+{_f('ist')}\s+(?:{_f('ein')}\s+)?{_f('beispieltext blindtext platzhaltertext beispielsatz mustertext')}|{_f('ceci')}\s+{_f('est')}\s+{_f('un')}\s+{_f('texte exemple')}|{_f('este esto')}\s+{_f('es')}\s+{_f('un')}\s+{_f('texto')}\s+{_f('de')}\s+{_f('ejemplo relleno')}|{_f('это')}\s+{_f('пример')}\s+{_f('текста')})",
        rf"(?:{_f('schreiben fügen ersetzen geben hier')})[^.!?]{{0,80}}?{_f('hier einfügen eintragen eingeben')}|(?:{_f('écrivez insérez remplacez saisissez décrivez')})[^.!?]{{0,80}}?(?:{_f('ici')}|{_f('ce')}\s+{_f('texte')})",
        rf"(?:{_f('escriba inserte reemplace introduzca describa')})[^.!?]{{0,80}}?(?:{_f('aquí')}|{_f('este')}\s+{_f('texto')})|(?:{_f('введите вставьте напишите замените опишите')})[^.!?]{{0,80}}?(?:{_f('здесь сюда')}|{_f('этот')}\s+{_f('текст')})",
        "(?:请)?在此处?[^。！？]{0,20}(?:填写|输入|插入|撰写)|ここに[^。！？]{0,30}(?:入力|記入|挿入|書いて)|여기에[^.!?]{0,40}(?:입력|작성|삽입|쓰세요)|(?:اكتب|أدخل|أدرج)[^.!?]{0,60}هنا|यहाँ[^।!?]{0,60}(?:लिखें|डालें|भरें)|(?:กรอก|พิมพ์|ใส่|เขียน)[^.!?\n]{0,60}ที่นี่",
    )
) + ")"


def blocks(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, block, fold): paragraphs, headings and lists outside code and tables, and how they are compared."""
    bare = F.regexp_replace(without_code(F.col(text)), F.lit("`[^`\n]+`"), F.lit(" "))
    parts = F.filter(F.transform(F.split(bare, "\n[^\\S\n]*\n", -1), lambda b, n: F.struct(n.alias("block_no"), b.alias("block"))), lambda x: ~x["block"].rlike("^\\s*(?:\\||$)"))
    # folded inside the array, so that no condition on the rows folds again
    return frame.select(F.col(key), F.inline(F.transform(parts, lambda x: F.struct(x["block_no"].alias("block_no"), x["block"].alias("block"), folded(x["block"]).alias("fold")))))


def unfilled(block: Column) -> Column:
    """Whether a sentence of the block holds a placeholder that it doesn't write about."""

    def one(sentence: Column) -> Column:
        bare = F.regexp_replace(sentence, F.lit(_QUOTED), F.lit(" "))
        share = F.length(F.regexp_replace(sentence, F.lit(PLACEHOLDER), F.lit(""))) / F.length(sentence)
        return bare.rlike(PLACEHOLDER) & (~sentence.rlike(_TUTORIAL) | (share <= 0.5))

    return F.when(block.rlike(SIGNS), F.exists(F.split(block, _SENTENCE, -1), one)).otherwise(False)


def is_filler(block: Column) -> Column:
    """Whether the block's words are stock, keyboard-row or repeated ones."""
    small = F.lower(block)
    words = F.array_remove(F.split(small, _NONE, -1), "")
    n = F.size(words)
    lorem = F.size(F.filter(words, lambda w: w.isin(*LOREM)))
    mash = F.size(F.filter(words, lambda w: w.rlike("^[asdfjklqwer]+$")))
    stock = F.when(small.rlike(_STOCK), ((n >= 4) & (lorem >= 0.5 * n)) | ((n >= 6) & (mash >= 0.9 * n))).otherwise(False)
    return ((n >= 6) & (F.size(F.array_distinct(words)) <= 0.25 * n)) | stock


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{M}]+", ""))


def is_message(block: Column, fold: Column) -> Column:
    """Whether the block, folded as fold, is what a server, a viewer or a template says."""
    bare = F.regexp_replace(fold, "\\S*[\\d/]\\S*", " ")  # identifiers
    speaks = bare.rlike(_ADDRESSED) | bare.rlike(_FAILED) | (bare.rlike(_SCRIPT) & bare.rlike(_NEEDED))
    long_enough = (F.size(F.split(F.trim(bare), "\\s+")) >= F.when(block.rlike("^\\s*##"), TITLE_WORDS + 1).otherwise(WORDS)) | (F.regexp_count(bare, F.lit("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsHangul}]")) >= LETTERS)
    left = _letters(F.regexp_replace(bare, _KNOWN, " "))
    built = F.when(fold.rlike(THING), ~bare.rlike(_STUDY) & long_enough & speaks & (left <= UNEXPLAINED * _letters(bare))).otherwise(False)
    titles = F.split(F.regexp_replace(block, F.lit("</(?:title|h1|h2|p|div)>|<hr */?>"), F.lit("\n")), "\n+")
    title = block.rlike(_TITLE) | F.when(block.rlike(f"[<#]|\\b{_CODES}\\b"), F.exists(titles, lambda t: t.rlike(f"[#<]|\\b{_CODES}\\b") & t.rlike(_TITLE))).otherwise(False)
    return F.when(block.rlike("[<{]"), block.rlike(_MARKUP)).otherwise(False) | title | fold.rlike(_INSTRUCTION) | built


def kind_of(block: Column, fold: Column | None = None) -> Column:
    """placeholder, filler or message; null for content."""
    return F.when(unfilled(block), "placeholder").when(is_filler(block), "filler").when(is_message(block, folded(block) if fold is None else fold), "message")


def residue(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, kind): every block that is residue, once per key."""
    return blocks(frame, key, text).select(key, "block_no", kind_of(F.col("block"), F.col("fold")).alias("kind")).where("kind IS NOT NULL").dropDuplicates([key, "block_no"])


def affected(frame: DataFrame, key: str, text: str) -> DataFrame:
    """The keys whose text holds residue."""
    return residue(frame, key, text).select(key).distinct()


def excluded(frame: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose text holds none."""
    return frame.join(affected(frame, key, text), key, "left_anti")
