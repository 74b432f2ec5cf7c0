"""Per-document text quality statistics, and the structure nearest to a text.

1. Language: every language has a profile of its function words, falling with
   their rank. A document takes the language whose profile lies at the least
   Jensen-Shannon divergence from the function words it holds.
2. Segments: a text is cut into runs of lines of one layout (marked entries,
   rows of cells, bare entries, running lines). Layout alone decides nothing:
   short or widely set lines that hold function words as prose does run on,
   whether they are verse, narrow columns or single words.
3. Structure: each segment becomes a distribution over function words, token
   classes and layout marks, and takes the profile at the least divergence:
   prose as rich in function words as its language, prose told by its classes
   of characters alone (languages without a profile), lists, tables, junk.

Scripts written without spaces are cut into pieces of two characters, and
Hangul words count as function words where a particle or ending closes them. A
document's kind follows from the shares of its non-blank characters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words by language, and the share of them in running text, in parts of a hundred.
FUNCTION_WORDS = {
    "en": "a about after all also an and any are as at be because been before but by can could did do for from had has have he her him his how i if in into is it its may more most no nor not of off on once only or our out over she should so some such than that the their them then there these they this to too under until up was we were what when which while who whose will with without would you your since although whenever unless yet",
    "de": "aber als am an auch auf aus bei bis da dann das dass dem den der des die dies dieser doch durch ein eine einem einen einer eines er es für hat haben ich ihr im in ist ja kaum kein keine mit nach nicht noch nur oder ob schon sehr sein sich sie sind so über um und uns unter vom von vor war waren warum was wenn werden wie wir wird zu zum zur",
    "es": "a al algo antes aunque con como cuando de del desde donde el ella en entre era es esa ese esta este está fue ha hasta hay la las le lo los más me mi muy no nos o otra otro para pero por porque qué que quien se según si sin sobre solo son su sus también tan tras un una uno vimos y ya",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vous",
    "it": "a al alla anche che chi come con da dal del della di e è era gli ha i il in la le lo ma mi nel nella non o per più se si sono su sua un una",
    "pt": "a ao as com como da das de do dos e é em entre esta estava foi mais mas na não nas no nos o os ou para pela pelo por que se sem ser seu sua um uma",
    "nl": "aan al als bij dat de die dit door een en er het hij ik in is maar met moet naar niet nog of om ook op over te tot uit van voor was wat we werd worden zijn",
    "pl": "a aby albo ale bardzo bez był była było być chociaż co czy dla do gdy go i ich jak jako jej jego jest jeszcze jeśli już która które który ma między mu na nad nie niż o od oraz po pod przed przez przy raz są się tak te ten to tylko tym w we więc z za ze zbyt że",
    "cs": "a aby ač ačkoli ale ani až bez bude by byl byla bylo být co dnes do ho i jak jako je jeho jej jen ještě jejich již jsem jsme jsou k každý která které který kde když ma má mezi na nad ne nebo není o od po pod podle pokud pro proto před při příliš s se si tak také tato ten tento to tím u už v ve však z za ze znovu že",
    "sv": "alla att av blev bli de del den denna det dess detta dig du där efter eller en ett från för ha hade han har hon hur i inte jag kan kunde man med men mot mycket må måste ni nu när och om oss på sedan sig sin ska skulle som så till trots under upp ut utan vad var vi vid än är över",
    "da": "af alle at blev blive da de dem den denne der deres det dette dig din du efter eller en er et for fra før ham han har havde hende hos hun hvad hvis hvor i igen ikke ind jeg kan kunne man med meget men mod må ned nogle nu når og også om op os på sig sin skal skulle som til ud under var ved vi vil være",
    "fi": "ei eivät en ennen että he hän ja jo jokin joka jos jälkeen kaikki kanssa kuin kun kuten liian me mikä minä mitä mutta myös ne niin niitä noin nyt ole olemme oli olivat olla on ovat se sekä sen siinä sitten sitä tai te toisessa tuo tämä uudelleen vaan vaikka vain vielä voi yli ylös",
    "hu": "a akkor ami amely az azonban azt bár be csak de e egy egyik el ennek és ez ezt fel ha hogy igen is itt ki kell képest le lehet ma majd már még meg mert mi mint minden nagyon ne nem nincs olyan ott össze persze s sem során szerint tehát túl több után új újra vagy van volt",
    "tr": "ama ancak bazı ben beri bile bir biz bu çok çünkü da daha de değil değildi diye en eğer gerekir gibi göre hem hep her hiç ikinci için ile ise iki kadar karşı ki kim mi mu mı mü ne neden o olan olarak olduğu oldu olmasına on ona onu önce rağmen sonra şey şu tarafından tekrar tüm üzere var ve veya ya yeniden yok",
    "ro": "a al ale acest această aceasta am ai are au că care ce cea cel cele cu cum da dacă dar de deși despre din după ea ei el era este eu fi fost fără iar în însă între la le lor lui mai mea mult ne nici nu o ori pe pentru prea prin sa sau se si și sub sunt să trebuie un una unei unui va vom",
    "ru": "а без более бы был была были было быть в вам вас весь во вот все вы где да даже для до его ее если есть ещё еще же за и из или им их к как когда кто который ли мы на над надо не нет ни но о об он она они от по под при раз с сегодня себя слишком со так также там то только том тот ты у уже хотя чем что чтобы эта это этот я",
    "uk": "а або але без би був була були було бути в вам вас вже від він вона вони все ви всі де для до є з за зі і й із їх його її коли крім лише ми на над надто не ні о об однак п'я по під при про раз сьогодні саме себе та так також там те ти тільки то тому у усі хоча це цей що щоб ще якщо як який треба я",
    "el": "αλλά αν ανά από αυτή αυτό αυτός για δεν δύο είναι είχαν είχε εκεί ένα ένας ενώ επειδή έχει έχουν η ήταν θα ή και κάθε κατά κι μας με μετά μέχρι μη μια μόνο μπορεί να ξανά ο οι όμως όπως όταν ότι ούτε πια πιο ποια πολύ που πρέπει πριν προς πως σαν σας σε στα στη στην στις στο στον στους τα τη την της τι τις το τον του τους των ως",
    "ar": "أن أو إذا إلى إن أي أنه التي الذي الذين أما بعد بل بين ثم جدا حتى حول حيث خلال ذلك رغم عن عند على غير فقد فقط في قبل قد كان كانت كل كما لا لأن لكن لم لما له لها ليس ما مثل مرة مع من منذ نحو هذا هذه هل هم هنا هناك هو هي و وقد وكان ولا ولم وهو وهي يجب يكن يكون",
    "he": "אבל או אותו אותה אחר אחרי אין איך אך אל אם אני אנחנו אף אשר את אתה באותו בין בלי גם הוא היא הייתה היו היה הם הן הנה הרבה ועוד זאת זה זו יותר יש כדי כי כך כל כמו לא לאחר להיות לו לפי לפני מאוד מדי מה מן מי נו עד עוד על עליו עם פי צריך רק שוב של שלא שם תחת",
    "hi": "अब अपना अपने आज इन इस इसके इसे उन उस उसके उसे एक और कर करना करने का कि किया की कुछ के को कोई क्या गई गए गया चाहिए जब जहाँ जाए जाता जो जैसे तक तब तो था थी थे दिया दो दोनों नहीं ने पर पहले फिर बहुत बाद भी मगर मुझे में मैं यदि यह यहाँ या ये रहा रही रहे लिए लेकिन वह वहाँ वे सकता सब साथ से हम हमने हालाँकि ही हुआ हुई हुए है हैं हो होता होती होना",
    "vi": "ai anh bạn bị bởi các cái cần cho chỉ chúng chưa có còn cùng cũng của dù đã đang đây để đến đi điều do đó được gì hai hay hơn khi không là làm lại lên lúc mà mặc máy mình một mười nay này nên nếu ngày nhiều những như nhưng nó ở phải phần quá ra rất rồi sau sẽ sự tại thì theo thêm thứ tôi trên trong từ và vào vẫn về vì việc với vừa",
    "id": "ada adalah agar akan anda antara apa atau bagi bahwa banyak beberapa belum bisa bukan dalam dan dapat dari daripada dengan di dia hanya harus hingga ia ini itu jika juga kalau kami karena ke kemudian kepada kita lagi lain lebih maka mereka meskipun namun oleh pada para pernah saat saja sangat saya sebagai sebelum sebuah secara sedang sejak seperti serta setelah suatu sudah telah terhadap terlalu tersebut tetapi tidak untuk yang",
    "sw": "ama au baada bado bila cha hadi hapa hata hii hili hiyo huo huu huyo ikiwa ile ilikuwa imekuwa ingawa ingine jinsi juu kabla kama kati katika kila kisha kuhusu kutoka kuwa kwa kwamba la lakini lazima leo mara mimi mpaka mwa na nao naye ndani ni nini nje pamoja pia sana sasa sisi tena tu vile vya wa wakati wako wala wao ya yake yao yeye yote za zaidi zote",
    "la": "a ab ac ad alia apud at atque aut autem contra cum de dum e ego eius enim erat esse esset est et etiam ex fuit haec hic hoc hodie iam id igitur ille in inde inter ipse is ita itaque iterum mane me mihi nam ne nec neque nihil nimis nisi non nos nunc ob per post pro qua quae quam quamquam quidem quod quoque sed si sic sine sub sum sunt tam tamen te tum ubi ut vel vero",
}
FUNCTION_SHARE = {
    "en": 38, "de": 38, "es": 38, "fr": 38, "it": 36, "pt": 36, "nl": 38, "pl": 26, "cs": 28, "sv": 34, "da": 34, "fi": 22, "hu": 30, "tr": 20, "ro": 32,
    "ru": 26, "uk": 26, "el": 36, "ar": 22, "he": 24, "hi": 36, "vi": 34, "id": 26, "sw": 26, "la": 26, "ko": 30,
}
# Characters and endings that mark function words where no space does.
_PARTICLE = re.compile("[的了在是不和就也我们有这那个着把被のはをにがでともたるれて]")
_KOREAN = re.compile("[\uac00-\ud7a3]+(?:은|는|이|가|을|를|에|의|도|로|와|과|만|서|다|요|고|며|지만|으면|까지|부터|에서|에게)")

CLASSES = ("func", "word", "data", "odd", "glued", "single", "hex", "echo", "stop", "sep", "cell", "bullet", "entry")

# Structural profiles over CLASSES, in parts of a hundred.
PROFILES = {
    **{("prose", f"language with {n} function words"): dict(func=n, word=86 - n, data=4, stop=6, sep=4) for n in sorted({*FUNCTION_SHARE.values()})},
    ("prose", "fewer function words"): dict(func=22, word=62, data=5, stop=8, sep=3),
    ("prose", "unknown language"): dict(func=8, word=76, data=4, stop=8, sep=4),
    ("list", "marked entries"): dict(func=1, word=57, data=12, bullet=15, entry=12, sep=3),
    ("list", "marked data"): dict(data=48, word=4, bullet=26, entry=18, sep=4),
    ("list", "bare entries"): dict(func=1, word=65, data=12, entry=20, sep=2),
    ("list", "bare data"): dict(data=55, word=5, entry=40),
    ("list", "run together"): dict(func=1, word=60, data=10, sep=29),
    ("list", "run together data"): dict(data=62, word=4, sep=34),
    ("table", "cells of data"): dict(data=46, word=9, cell=45),
    ("table", "cells of words"): dict(data=15, word=40, cell=45),
    ("table", "wide cells"): dict(func=2, data=28, word=42, cell=28),
    ("junk", "unreadable tokens"): dict(odd=75, word=18, sep=4, stop=3),
    ("junk", "some unreadable tokens"): dict(odd=45, word=40, single=5, sep=6, stop=4),
    ("junk", "dump"): dict(hex=92, data=6, odd=2),
    ("junk", "glued words"): dict(glued=70, word=22, func=4, sep=4),
    ("junk", "single letters"): dict(single=78, func=10, word=6, stop=3, sep=3),
    ("junk", "repeats"): dict(echo=70, word=10, data=5, sep=15),
}
KINDS = ("prose", "list", "table", "junk")

_NAMES = list(PROFILES)
_P = np.array([[p.get(c, 0) for c in CLASSES] for p in PROFILES.values()], dtype=float)
_P /= _P.sum(1, keepdims=True)
_P_SUM = (_P * np.log2(_P + 1e-300)).sum(1)
_AT = {c: i for i, c in enumerate(CLASSES)}
_BY_WORD: dict[str, tuple[str, ...]] = {}
#: A language's profile over its function words: falls with the place in its list by length, as short ones are the more frequent.
LANGUAGE: dict[str, dict[str, float]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    _weights = {w: 1.0 / (3 + len(w)) for w in dict.fromkeys(_words.split())}
    LANGUAGE[_lang] = {w: x / sum(_weights.values()) for w, x in _weights.items()}
    for _w in LANGUAGE[_lang]:
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _lang)
#: Prose profiles that a document of a language is compared with, beside the others.
_OTHER = [i for i, (k, v) in enumerate(PROFILES) if k != "prose" or not v.startswith("language with")]
_OF_LANGUAGE = {l: np.array([*_OTHER, _NAMES.index(("prose", f"language with {n} function words"))]) for l, n in FUNCTION_SHARE.items()}
_OF_LANGUAGE[None] = np.array(_OTHER)

_BULLET = re.compile(r"^\s*(?:[-*+•·–—~]{1,3}|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,4})[.)\]:]|[\[(][ xX✓✔*-]?[\])]|[☐☑✓✔▪◦‣○●■□→])\s+\S")
_GAP = re.compile(r"\S(\t+| {2,})(?=\S)")
_CELL_SPLIT = re.compile(r"[\s|;,]+|\t")
_RULE = re.compile(r"^[\s|+:=_-]{3,}$")
_DELIM = re.compile(r"[,;|\t](?=\S)|[;,|](?=[,;|]|$)")
_NUMBER = re.compile(r"^[-+]?\d+(?:[.,:]\d+)*(?:[eE][-+]?\d+)?%?$")
_HEX = re.compile(r"^(?:[0-9a-fA-F]{2}|[0-9a-fA-F]{4}|(?=[a-fA-F]*\d)[0-9a-fA-F]{7,})$")
_EMPTY = {"na", "nan", "n/a", "null", "none", "-", "--", "—", "–", "?"}
_STOPS, _SEPS = ".!?…。！？｡।॥؟۔։።", ",;、，；،؛"
_EDGE = "\"'`*_()[]{}<>«»“”„‘’‚¿¡,;:.!?…|" + _STOPS + _SEPS + "：「」『』（）《》〈〉【】"
# Scripts without spaces: Thai to Lao, Burmese, Khmer, kana, ideographs.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3031-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(rf"[{_UNSPACED}]{{2}}")
_RUN = re.compile(rf"((?:[{_UNSPACED}]){{1,2}}[^\w\s]*)")
_MARKS = frozenset("~!@#$^&*<>{}[]\\|;?=")
_MARK = re.compile(r"[~!@#$^&*<>{}\[\]\\?=]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_SEPARATORS = {"/", "|", "·", "•", "-", "–", "—", ">"}
_NO_VOWEL = re.compile(r"[^aeiouyäöüáéíóúàèìòùâêîôûåøæœ\W\d_]{4,}")
_WORDISH = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ODD_INSIDE = re.compile(r"[^\W\d_][;\[\]{}<>|~^@#$%&*=+\\!?\"]+[^\W\d_]|[^\W\d_]['’,][^\W\d_]{3,}|[;\[\]{}\\]{2,}|^[;'\[\],]+[^\W\d_]")


def _strange(ch: str) -> bool:
    """A character that running text in no script holds: letters, marks, digits and the punctuation of scripts are ordinary."""
    o = ord(ch)
    if o < 0x80:
        return o < 32
    if ch in "«»“”„‘’‚–—…·•°±²³µ×÷¿¡§€£№":
        return False
    if o < 0xA0 or 0xFFF0 <= o <= 0xFFFF or 0xE000 <= o <= 0xF8FF:
        return True
    if ch in _EDGE or ch in "\u200c\u200d・〜":
        return False
    return not ch.isalpha() and not ch.isdigit() and unicodedata.category(ch)[0] != "M"


# Letters that ordinary words of Latin script may hold in plenty.
_LATIN_MORE = frozenset(map(chr, range(0x1E00, 0x1F00))) | set("đĐăĂơƠưƯĩĨũŨàâáãäåæçèéêëìíîïñòóôõöøùúûüýąćčďęěğįıłńňőřśšşșťţțůűźżžÇÖÜŞĞİ")
_WIDE = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "IDEOGRAPHIC": "CJK"}


def _tokens(text: str) -> list[str]:
    """The tokens of a text at spaces; runs of a script without spaces fall into pieces of two characters."""
    if text.isascii() or not _HAS_UNSPACED.search(text):
        return text.split()
    return [p for t in text.split() for p in _RUN.split(t) if p]


def _scripts(word: str) -> int:
    """How many alphabets a word mixes."""
    seen = set()
    for ch in word:
        if ch.isalpha():
            name = "LATIN" if ord(ch) < 0x250 else unicodedata.name(ch, "?").split()[0]
            seen.add(_WIDE.get(name, name))
    return len(seen)


def _class(token: str) -> str:
    core = token.strip(_EDGE)
    low = core.lower()
    if len(core) > 24:
        if len(core) > 40 and max(map(len, re.findall(r"[^\W\d_]+", core)), default=0) > 20:
            return "glued"
        if re.search(r"[a-z][A-Z]", core) and re.search(r"[A-Z][a-z]?[A-Z]|\d[A-Za-z]", core) and "." not in core and "_" not in core:
            return "odd"  # encoded bytes
    if not core:
        return "data" if token in _EMPTY or token.isascii() and len(token) <= 2 else "odd"
    if low in _BY_WORD and token.strip(_EDGE).lower() == token.rstrip(".,;:!?" + _STOPS + _SEPS).strip("\"'()*_`“”„«»¿¡").lower():
        return "func"
    if _PARTICLE.search(core) and _HAS_UNSPACED.match(core):
        return "func"
    if "\uac00" <= core[-1] <= "\ud7a3" and len(core) > 1 and _KOREAN.fullmatch(core):
        return "func"
    if low in _EMPTY or _NUMBER.match(core):
        return "hex" if len(core) in (2, 8) and core.isdigit() else "data"
    if _HEX.match(core) and (not core.isalpha() or len(core) == 2 and low not in ("ad", "be")):
        return "hex"
    n_strange = sum(map(_strange, core))
    if n_strange and (n_strange > 1 or n_strange * 4 >= len(core)):
        return "odd"
    if core.isalpha() or not core.isascii() and all(c.isalpha() or unicodedata.category(c)[0] == "M" or c in "\u200c\u200d" for c in core):
        if len(core) == 1:
            return "word" if _HAS_UNSPACED.match(core * 2) else "single"
        if len(core) > 24:
            return "glued"
        if _scripts(core) > 1 or not core.isascii() and sum(ord(c) > 0x7F and c not in _LATIN_MORE for c in core) * 2 > len(core) and _scripts(core) == 1 and ord(core[0]) < 0x250 and len(core) > 2:
            return "odd"
        if core.isascii() and (_NO_VOWEL.search(low) and len(_NO_VOWEL.search(low)[0]) >= 5 or len(core) > 3 and not re.search(r"[aeiouy]", low) and not core.isupper()):
            return "odd"
        return "odd" if _ODD_INSIDE.search(token) else "word"
    if any(ch.isdigit() for ch in core):
        if len(core) > 24 and not re.search(r"[/_.-]", core):
            return "odd"
        n_marks = sum(map(_MARKS.__contains__, core))
        return "odd" if n_marks > 1 or n_marks and len(core) < 5 else "data"
    if "/" in core or "_" in core or "." in core:
        return "data" if re.fullmatch(r"[\w./:-]+", core) else "odd"
    if len(core) > 40:
        return "glued"
    if _ODD_INSIDE.search(token) or not _WORDISH.fullmatch(core):
        return "odd"
    return "word"


class Lexicon(dict):
    """What is known of a token, kept between texts: class, core, whether it is a function word, how it ends (1 stop, 2 separator), weight, letters and digits."""

    def __missing__(self, token: str) -> tuple[int, str, bool, int, float, int, int]:
        kind = _class(token)
        core = token.strip(_EDGE).lower()
        end = 1 if token[-1] in _STOPS else 2 if token[-1] in _SEPS or token in _SEPARATORS else 0
        got = (_AT[kind], core or token, kind == "func" or core in _BY_WORD, end, max(1.0, len(token) / 10) if kind == "glued" else 1.0, sum(map(str.isalpha, token)), sum(map(str.isdigit, token)))
        if len(self) < 200_000 and len(token) <= 64:  # a cache only
            self[token] = got
        return got


def _shape(line: str, lexicon: Lexicon) -> str:
    """The layout of one line: ``bullet``, ``cell``, ``gap`` (cells set apart by blanks), ``entry`` or ``text``."""
    s = line.strip()
    if _RULE.match(s):
        return "cell"
    if len(s) > 8:
        solid = len(s) - s.count(" ") - s.count("\t")
        if (solid - len(_SYMBOL.findall(s))) * 4 < solid or len(_MARK.findall(s)) * 7 > len(s):
            return "text"  # marks all over: no cells
    if _BULLET.match(line) and not _HEX.match(s.split()[0]):
        return "bullet"
    tokens = _tokens(s)
    if s.count("|") >= 2 or len(_GAP.findall(s)) >= 2 or "\t" in s:
        # Running text may be set with wide gaps; columns hold hardly any function words.
        running = sum(lexicon[t][2] and t.lower() not in _EMPTY for t in tokens) >= 0.18 * len(tokens)
        if not running and _HAS_UNSPACED.search(s):
            running = len(s) >= 9 * len(_GAP.split(s)[::2])
        return "text" if running else "cell" if "|" in s else "gap"
    for d in ",;":
        n = s.count(d)
        tight = n - len(re.findall(re.escape(d) + r"\s", s))
        if n >= 2 and tight >= 2 and tight * 2 >= n and len(tokens) <= 2 + n and not any(len(t) > 3 and t.count(d) == 1 and t[0] == d for t in tokens):
            return "cell" if _looks_cells(s, d) else "text"
    if len(tokens) <= 6 and s[-1:] not in _STOPS + ":：" and not any(lexicon[t][2] for t in tokens):
        return "entry"
    return "text"


def _looks_cells(s: str, d: str) -> bool:
    cells = [c.strip() for c in s.split(d)]
    good = sum(1 for c in cells if not c or len(c) <= 30 and re.fullmatch(r"[-+]?[\w.%/:-]+(?: [\w.%/:-]+){0,3}", c) is not None)
    return good >= 0.8 * len(cells)


def _segments(text: str, lexicon: Lexicon, need: float) -> Iterator[tuple[str, list[str]]]:
    """Runs of lines of one layout. A run of fewer than three lines inside a paragraph joins what is before it.

    Short lines and lines with wide gaps are running text where a share of
    ``need`` of their words, in the paragraph or (if it has fewer than four of
    them) in the whole text, are function words.
    """
    parts = []
    for part in re.split(r"\n[^\S\n]*\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        lines = [x for x in part.split("\n") if x.strip()]
        if lines and all(x.lstrip().startswith(">") for x in lines):
            lines = [x.lstrip().lstrip("> ") for x in lines]  # quoted
            lines = [x for x in lines if x.strip()]
        shapes = [_shape(x, lexicon) for x in lines]
        n = words = func = 0
        if any(x in ("entry", "gap") for x in shapes):
            for line, shape in zip(lines, shapes):
                if shape in ("entry", "gap", "text"):
                    own = _tokens(line)
                    if len(own) <= 6 or shape == "gap":
                        n, words, func = n + 1, words + len(own), func + sum(lexicon[t][2] and t.lower() not in _EMPTY for t in own)
        parts.append((lines, shapes, n, words, func))
    whole = sum(p[4] for p in parts) >= need * max(1, sum(p[3] for p in parts))
    for lines, shapes, n, words, func in parts:
        if n and (func >= need * words if n >= 4 else whole):
            shapes = ["text" if x in ("entry", "gap") else x for x in shapes]
        runs: list[tuple[str, list[str]]] = []
        for line, shape in zip(lines, shapes):
            shape = "cell" if shape == "gap" else shape
            if runs and runs[-1][0] == shape:
                runs[-1][1].append(line)
            else:
                runs.append((shape, [line]))
        merged: list[tuple[str, list[str]]] = []
        for shape, own in runs:
            if merged and len(runs) > 1 and (shape in ("entry", "text") and len(own) < 3 and merged[-1][0] in ("entry", "text") or len(own) == 1 and merged[-1][0] == "cell" and shape == "entry"):
                merged[-1][1].extend(own)
            else:
                merged.append((shape, list(own)))
        yield from merged


def _distribution(shape: str, lines: list[str], lexicon: Lexicon) -> np.ndarray:
    n = [0.0] * len(CLASSES)
    cores: list[str] = []
    kinds: list[int] = []
    stop, sep, cell, bullet, entry = (_AT[c] for c in ("stop", "sep", "cell", "bullet", "entry"))
    for line in lines:
        s = line.strip()
        if shape == "bullet":
            n[bullet] += 1
            s = _BULLET.sub(lambda m: m[0][-1], s)
        if shape == "cell":
            n[cell] += len(_GAP.findall(s)) + len(_DELIM.findall(s))
            tokens = [t for t in _CELL_SPLIT.split(s) if t]
        else:
            tokens = _tokens(s)
        for t in tokens:
            kind, core, _, end, weight, _, _ = lexicon[t]
            n[kind] += weight
            cores.append(core)
            kinds.append(kind)
            if end and shape != "cell":
                n[stop if end == 1 else sep] += 1
        if tokens and shape in ("entry", "bullet") and len(tokens) <= 12 and tokens[-1][-1] not in _STOPS.replace("…", ""):
            n[entry] += 1
    # A phrase that makes up a twelfth of the segment or more is a loop, not speech.
    if len(cores) > 4:
        grams = list(zip(["", "", *cores], ["", *cores], cores))
        common = {g: c for g, c in Counter(grams).items() if c > 4 and c * 12 >= len(cores)}
        for g, kind in {g: k for g, k in zip(grams, kinds) if g in common}.items() if common else ():
            moved = min(common[g] - 2, n[kind])
            n[kind] -= moved
            n[_AT["echo"]] += moved
    v = np.array(n)
    if shape == "cell" and v[_AT["hex"]] < 0.5 * v[:stop].sum() or shape != "cell" and v[_AT["hex"]] < 0.4 * v.sum():
        v[_AT["data"]] += v[_AT["hex"]]  # a few short hexadecimal words are data
        v[_AT["hex"]] = 0
    if v[_AT["single"]] < 0.2 * v.sum():
        v[_AT["word"]] += v[_AT["single"]]
        v[_AT["single"]] = 0
    if v[_AT["hex"]]:
        v[cell] = v[entry] = v[bullet] = 0
    return v


def divergence(p: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The Jensen-Shannon divergence in bits of ``p`` from the profiles ``rows``."""
    m = _P[rows] + p
    mixed = (m * np.log2(m / 2 + 1e-300)).sum(1) / 2
    return (_P_SUM[rows] + (p * np.log2(p + 1e-300)).sum()) / 2 - mixed


def language_of(counts: Counter) -> str | None:
    """The language whose profile lies at the least Jensen-Shannon divergence from the function words counted; NULL without any."""
    votes: Counter = Counter()
    for w, c in counts.items():
        for lang in _BY_WORD.get(w) or (("ko",) if "\uac00" <= w[-1] <= "\ud7a3" else ()):
            votes[lang] += c
    best, least = None, 2.0
    total = sum(counts.values())
    most = max(votes.values(), default=0)
    for lang in sorted(x for x, c in votes.items() if 4 * c >= 3 * most):  # a language that lacks more of the words is farther off
        own = LANGUAGE.get(lang)
        d = 0.0
        if own is None:  # Hangul, by its particles
            d = 1.0 - votes[lang] / total
        else:
            held = 0.0
            for w, c in counts.items():
                p, q = c / total, own.get(w, 0.0)
                held += q
                d += p * math.log2(2 * p / (p + q)) + (q * math.log2(2 * q / (p + q)) if q else 0.0)
            d = (d + 1.0 - held) / 2
        if d < least:
            best, least = lang, d
    return best


_STATS = [
    ("n_chars", pa.int64()), ("n_words", pa.int64()), ("n_lines", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()),
    ("digit_ratio", pa.float64()), ("ended_lines", pa.float64()), ("common_words", pa.float64()), ("language", pa.string()),
    ("prose_divergence", pa.float64()), ("list_share", pa.float64()), ("table_share", pa.float64()), ("junk_share", pa.float64()), ("kind", pa.string()),
]
STATS_DDL = "n_chars long, n_words long, n_lines long, mean_word_length double, symbol_ratio double, digit_ratio double, ended_lines double, common_words double, language string, prose_divergence double, list_share double, table_share double, junk_share double, kind string"
_PROSE = np.array([k == "prose" for k, _ in _NAMES])


def describe(text: str | None, lexicon: Lexicon | None = None) -> tuple:
    """The statistics of one text, in the order of ``STATS_DDL``."""
    lexicon = Lexicon() if lexicon is None else lexicon
    blank = text is None or not text.strip()
    if blank:
        return (len(text or ""), 0, 0, None, None, None, None, None, None, None, 0.0, 0.0, 0.0, None)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    tokens = _tokens(text)
    solid = sum(map(len, tokens))
    known = [lexicon[t] for t in tokens]
    letters, digits = sum(k[5] for k in known), sum(k[6] for k in known)
    share = dict.fromkeys(KINDS, 0.0)
    best = language_of(Counter(k[1] for k in known if k[0] == _AT["func"]))
    rows = _OF_LANGUAGE[best]
    apart = 0.0
    for shape, own in _segments(text, lexicon, 0.005 * FUNCTION_SHARE.get(best, 24)):
        v = _distribution(shape, own, lexicon)
        size = sum(len("".join(x.split())) for x in own)
        if not v.sum():
            continue
        d = divergence(v / v.sum(), rows)
        share[_NAMES[rows[int(d.argmin())]][0]] += size / solid
        apart += float(d[_PROSE[rows]].min()) * size / solid
    other = {k: share[k] for k in KINDS[1:]}
    kind = max(other, key=other.get) if sum(other.values()) > 0.5 else "prose"
    common = sum(k[2] for k in known)
    return (
        len(text), len(tokens), len(lines), solid / len(tokens), (solid - letters - digits) / solid, digits / solid, sum(x[-1] in _STOPS + "\"”»」』" for x in lines) / len(lines),
        common / len(tokens), best, apart, share["list"], share["table"], share["junk"], kind,
    )


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``key`` and the statistics, in one pass without a shuffle.

    NULL and blank texts have zero words, NULL ratios and a NULL kind. Rows
    without key and repeated rows come out as they are. Whole texts are read,
    however long. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    fields = [pa.field("key", pa.int64()), *[pa.field(n, t) for n, t in _STATS]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            rows = [describe(t, lexicon) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[] for _ in _STATS]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *[pa.array(c, type=t) for c, (_, t) in zip(cols, _STATS)]], schema=pa.schema(fields))

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(scan, f"key long, {STATS_DDL}")
    return out.withColumnRenamed("key", key)
