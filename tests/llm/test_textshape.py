import random
import string

import pytest

from spikeloom.llm.textshape import describe, text_statistics

EN = "We counted 12 spikes in the second section, although the pump ran dry. If the filter is broad, then the batch should be checked again. "
DE = "Die Messung war am Morgen nicht stabil. Wir sahen noch neun Spikes, aber die Kurve stieg kaum, weil der Chip alt war. "
ES = "La señal subió antes del lavado, pero no con luz azul. No se sabe por qué la tabla cambió en la segunda vuelta. "
FR = "Le signal est monté avant le lavage, mais pas dans la lumière bleue. Nous ne savons pas pourquoi la courbe a changé. "


def kind(text):
    return describe(text)[-1]


def wrap(text, n):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > n:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


@pytest.mark.parametrize("text", [EN, DE, ES, FR])
def test_prose_in_any_language_and_layout(text):
    for t in (text, text * 5, wrap(text * 5, 50), wrap(text * 4, 30), text.replace(". ", ".\n"), text.replace(". ", ".\n\n"), "> " + wrap(text * 3, 40).replace("\n", "\n> "), "<p>" + text * 3 + "</p>", text.replace(" ", "  "), text.replace(" ", "\t")):
        assert kind(t) == "prose", t


def test_lists():
    items = ["trigger pulse", "cold burst", "raw/dim_3.h5", "unit_041", "Sorter label: warm batch", "gain setting (7 units)", "check the chip"] * 4
    for mark in ("- ", "* ", "{}. ", "{}) ", "(x) ", "[ ] ", "• ", ""):
        assert kind("\n".join(mark.format(i + 1) + x for i, x in enumerate(items))) == "list", mark
    for sep in (", ", "; ", " / "):
        assert kind(sep.join(items)) == "list", sep


def test_tables():
    rng = random.Random(0)
    rows = [[f"unit_{rng.randrange(500):03d}", f"{rng.random() * 90:.3f}", rng.choice(["warm", "cold", "NA", ""]), str(rng.randrange(4000))] for _ in range(15)]
    for d in (",", ";", "\t", "|"):
        assert kind("\n".join(d.join(r) for r in [["name", "rate", "kind", "n"], *rows])) == "table", d
    assert kind("\n".join("".join(c.ljust(14) for c in r) for r in rows)) == "table"
    assert kind("| a | b |\n|---|---|\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows)) == "table"


def test_junk():
    rng = random.Random(1)
    dump = "\n".join(f"{16 * i:08x}  " + " ".join(f"{rng.randrange(256):02x}" for _ in range(16)) for i in range(12))
    code = "\n".join("".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(10))
    marks = "\n".join("".join(rng.choice("~!@#$%^&*_=:.<>|-") for _ in range(40)) for _ in range(10))
    bad = " ".join("".join(rng.choice("Ã€¾Šâ™¢Ð¿Ñ½œžein") for _ in range(rng.randrange(3, 9))) for _ in range(80))
    keys = " ".join("".join(rng.choice("qwzkjhgfds;[',p") for _ in range(rng.randrange(3, 9))) for _ in range(80))
    for t in (dump, code, marks, bad, keys, EN.replace(" ", "") * 4, " ".join(EN.replace(" ", "") * 3), "NaN, " * 60, "cold burst\n" * 40):
        assert kind(t) == "junk", t[:80]


def test_mixed_by_share():
    rows = "\n".join(f"unit_{i:03d},{i}.5,warm,{i * 3}" for i in range(20))
    assert kind(EN + "\n\n" + rows) == "table"
    assert kind(EN * 12 + "\n\n" + rows) == "prose"


def test_columns_and_dirt(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, EN), (4, EN), (None, EN), (5, "word " * 200_000), (6, "\x00\x01"), (7, "a")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, kind string")
    got = [r.asDict() for r in text_statistics(df).collect()]
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert r["n_words"] == 0 and r["kind"] is None and r["mean_word_length"] is None
    one = next(r for r in got if r["doc_id"] == 4)
    assert one["n_words"] == len(EN.split()) and one["language"] == "en" and one["kind"] == "prose" and one["ended_lines"] == 1.0
    assert one["mean_word_length"] == pytest.approx(sum(map(len, EN.split())) / len(EN.split()))
    assert text_statistics(df.limit(0)).count() == 0


TEXTS = {
    "en": "We counted twelve spikes in the second section, although the pump ran dry. If the filter is too broad, then the batch should be checked again by someone else. Nobody knows why the curve changed after the wash.",
    "de": "Die Messung war am Morgen nicht stabil. Wir sahen noch neun Signale, aber die Kurve stieg kaum, weil der Chip alt war. Niemand weiß, warum sich das nach dem Spülen geändert hat.",
    "es": "La señal subió antes del lavado, pero no con luz azul. No se sabe por qué la tabla cambió en la segunda vuelta. Si el filtro es demasiado ancho, hay que revisarlo otra vez.",
    "fr": "Le signal est monté avant le lavage, mais pas dans la lumière bleue. Nous ne savons pas pourquoi la courbe a changé. Si le filtre est trop large, il faut le vérifier encore.",
    "it": "La misura di stamattina non era stabile. Abbiamo contato dodici segnali nella seconda parte, anche se la pompa si era fermata. Se il filtro è troppo largo, bisogna controllarlo di nuovo.",
    "pt": "A medição desta manhã não estava estável. Contámos doze sinais na segunda parte, embora a bomba tivesse parado. Se o filtro for demasiado largo, deve ser verificado outra vez.",
    "nl": "De meting van vanochtend was niet stabiel. We telden twaalf signalen in het tweede deel, hoewel de pomp was gestopt. Als het filter te breed is, moet het opnieuw worden gecontroleerd.",
    "pl": "Dzisiejszy poranny pomiar nie był stabilny. W drugiej części naliczyliśmy dwanaście sygnałów, chociaż pompa się zatrzymała. Jeśli filtr jest zbyt szeroki, trzeba go jeszcze raz sprawdzić.",
    "cs": "Dnešní ranní měření nebylo stabilní. Ve druhé části jsme napočítali dvanáct signálů, ačkoli se čerpadlo zastavilo. Pokud je filtr příliš široký, je třeba jej znovu zkontrolovat.",
    "sv": "Mätningen i morse var inte stabil. Vi räknade tolv signaler i den andra delen, trots att pumpen hade stannat. Om filtret är för brett måste det kontrolleras en gång till.",
    "da": "Målingen i morges var ikke stabil. Vi talte tolv signaler i den anden del, selv om pumpen var stoppet. Hvis filteret er for bredt, skal det kontrolleres igen.",
    "fi": "Aamun mittaus ei ollut vakaa. Laskimme kaksitoista signaalia toisessa osassa, vaikka pumppu oli pysähtynyt. Jos suodatin on liian leveä, se on tarkistettava uudelleen.",
    "hu": "A ma reggeli mérés nem volt stabil. A második részben tizenkét jelet számoltunk, bár a szivattyú leállt. Ha a szűrő túl széles, akkor újra ellenőrizni kell.",
    "tr": "Bu sabahki ölçüm kararlı değildi. Pompa durmuş olmasına rağmen ikinci bölümde on iki sinyal saydık. Filtre çok genişse yeniden kontrol edilmesi gerekir.",
    "ro": "Măsurătoarea din această dimineață nu a fost stabilă. Am numărat douăsprezece semnale în partea a doua, deși pompa se oprise. Dacă filtrul este prea larg, trebuie verificat din nou.",
    "ru": "Измерение сегодня утром было нестабильным. Мы насчитали двенадцать сигналов во второй части, хотя насос остановился. Если фильтр слишком широкий, его надо проверить ещё раз.",
    "uk": "Вимірювання сьогодні вранці було нестабільним. Ми нарахували дванадцять сигналів у другій частині, хоча насос зупинився. Якщо фільтр занадто широкий, його треба перевірити ще раз.",
    "el": "Η μέτρηση σήμερα το πρωί δεν ήταν σταθερή. Μετρήσαμε δώδεκα σήματα στο δεύτερο μέρος, αν και η αντλία είχε σταματήσει. Αν το φίλτρο είναι πολύ πλατύ, πρέπει να ελεγχθεί ξανά.",
    "ar": "لم يكن القياس هذا الصباح مستقرا. عددنا اثنتي عشرة إشارة في الجزء الثاني، رغم أن المضخة توقفت. إذا كان المرشح واسعا جدا فيجب فحصه مرة أخرى.",
    "he": "המדידה הבוקר לא הייתה יציבה. ספרנו שנים עשר אותות בחלק השני, אף על פי שהמשאבה נעצרה. אם המסנן רחב מדי, צריך לבדוק אותו שוב.",
    "hi": "आज सुबह की माप स्थिर नहीं थी। हमने दूसरे भाग में बारह संकेत गिने, हालाँकि पंप बंद हो गया था। यदि फ़िल्टर चौड़ा है, तो उसे फिर से जाँचना चाहिए।",
    "zh": "今天早上的测量并不稳定。我们在第二部分数了十二个信号，虽然水泵已经停了。如果滤波器太宽，就应该再检查一次。没有人知道曲线为什么会变。",
    "ja": "今朝の測定は安定していなかった。ポンプが止まったのに、第二部分で十二個の信号を数えた。フィルターが広すぎるなら、もう一度確認するべきだ。",
    "ko": "오늘 아침의 측정은 안정적이지 않았다. 펌프가 멈췄지만 우리는 두 번째 부분에서 신호를 세었다. 필터가 너무 넓으면 다시 확인해야 한다.",
    "th": "การวัดเมื่อเช้านี้ไม่คงที่ เรานับสัญญาณได้สิบสองครั้งในส่วนที่สอง แม้ว่าปั๊มจะหยุดทำงานแล้ว ถ้าตัวกรองกว้างเกินไปก็ควรตรวจสอบอีกครั้ง",
    "vi": "Phép đo sáng nay không ổn định. Chúng tôi đếm được mười hai tín hiệu trong phần thứ hai, mặc dù máy bơm đã dừng. Nếu bộ lọc quá rộng thì cần được kiểm tra lại.",
    "id": "Pengukuran pagi ini tidak stabil. Kami menghitung dua belas sinyal di bagian kedua, meskipun pompa sudah berhenti. Jika filter terlalu lebar, maka harus diperiksa lagi.",
    "sw": "Kipimo cha asubuhi ya leo hakikuwa imara. Tulihesabu ishara kumi na mbili katika sehemu ya pili, ingawa pampu ilikuwa imesimama. Ikiwa kichujio ni kipana sana, lazima kikaguliwe tena.",
    "la": "Mensura hodie mane facta non erat stabilis. In parte secunda duodecim signa numeravimus, quamquam antlia constiterat. Si colum nimis latum est, iterum inspiciendum erit.",
}


def verse(text, k=4):
    words = [x.strip(".,") for x in text.split()]
    return "\n".join(" ".join(words[i : i + k]).capitalize() for i in range(0, len(words), k))


def stanzas(text):
    lines = verse(text).split("\n")
    return "\n\n".join("\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4))


LAYOUTS = {
    "plain": lambda t: t, "a word a line": lambda t: "\n".join(t.split()), "verse": verse, "stanzas": stanzas, "narrow": lambda t: wrap(t, 18),
    "wide gaps": lambda t: t.replace(" ", "   "), "tabs": lambda t: t.replace(" ", "\t"), "capitals": str.upper, "one sentence": lambda t: t.split(". ")[0] + ".",
    "indented": lambda t: "    " + wrap(t, 40).replace("\n", "\n    "), "quoted": lambda t: "> " + wrap(t, 40).replace("\n", "\n> "),
    "no punctuation": lambda t: t.replace(".", "").replace(",", "").lower(), "double spaced": lambda t: wrap(t, 50).replace("\n", "\n\n"),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_prose_of_any_language_in_any_layout(layout):
    assert {lang: k for lang, t in TEXTS.items() if (k := kind(LAYOUTS[layout](t))) != "prose"} == {}


def test_language():
    assert {lang for lang, t in TEXTS.items() if describe(t)[8] != lang} <= {"zh", "ja", "th"}  # told by their characters only


def test_lists_and_tables_of_other_languages():
    for items in (["pompa perystaltyczna", "filtr szeroki", "kamera boczna", "stół laboratoryjny", "zawór iglicowy", "czujnik ciśnienia", "kabel zasilający", "płytka elektrod"], ["насос", "широкий фильтр", "боковая камера", "лабораторный стол", "игольчатый клапан", "датчик давления", "кабель питания"], ["蠕动泵", "宽带滤波器", "侧面相机", "实验台", "针阀", "压力传感器", "电源线", "电极板"]):
        for mark in ("- ", "", "1. "):
            assert kind("\n".join(mark + x for x in items * 3)) == "list"
        assert kind(", ".join(items * 3)) == "list"
        assert kind("\n".join(f"{x}\t{i}\t{i * 0.7:.2f}\tok" for i, x in enumerate(items * 2))) == "table"


def test_runs_of_symbols_are_junk():
    rng = random.Random(5)
    for alphabet in ("~!@#$%^&*_=:.<>|-+;,/?", "~!@#$%^&*_=:.<>|-+;,/? ", "|  ~^%&", "~!@#$%^&*|;,abcdef12345 "):
        for rows in (1, 3, 8):
            text = "\n".join("".join(rng.choice(alphabet) for _ in range(50)) for _ in range(rows))
            assert kind(text) == "junk", text
