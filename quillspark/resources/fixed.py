"""Fixed values of the detection model, as text, and the tables that are read from them.

The values below decide results: names, registration order, cue words, character weights and
alphabets have to be just these. Everything larger is built: script ranges from the Unicode
database, profiles by training.
"""

from __future__ import annotations

# Writing systems.
SCRIPT_NAMES_TEXT = """
Arab: Arabic
Armn: Armenian
Beng: Bengali
Cyrl: Cyrillic
Deva: Devanagari
Geor: Georgian
Hani: Han
Hebr: Hebrew
Jpan: Japanese
Latn: Latin
Telu: Telugu
"""

# Languages, in their order.
LANGUAGE_NAMES_TEXT = """
ar: Arabic
az: Azerbaijani
bn: Bengali
de: German
en: English
es: Spanish
fa: Persian (Farsi)
fr: French
ha: Hausa
he: Hebrew
hi: Hindi
hy: Armenian
id: Indonesian
ja: Japanese
ka: Georgian
kk: Kazakh
ku: Kurdish
ky: Kyrgyz
mr: Marathi
pa: Punjabi
pcm: Nigerian Pidgin
pt: Portuguese
ps: Pashto
ru: Russian
sd: Sindhi
sw: Swahili
te: Telugu
tg: Tajik
tk: Turkmen
tr: Turkish
uk: Ukrainian
ur: Urdu
ug: Uyghur
uz: Uzbek
vi: Vietnamese
yi: Yiddish
zh: Mandarin Chinese
"""

# Profiles in registration order, with the sample of each.
PROFILES_TEXT = """
ar-Arab arabic/sample.txt
ar-Arab-ACM arabic/sample_acm.txt
ar-Arab-ACQ arabic/sample_acq.txt
ar-Arab-AJP arabic/sample_ajp.txt
ar-Arab-APC arabic/sample_apc.txt
ar-Arab-ARS arabic/sample_ars.txt
ar-Arab-ARZ arabic/sample_arz.txt
az-Arab azerbaijani/sample_arab.txt
az-Cyrl azerbaijani/sample_cyrl.txt
az-Latn azerbaijani/sample.txt
bn-Beng bengali/sample.txt
de-Latn german/sample.txt
en-Latn english/sample.txt
es-Latn spanish/sample.txt
fa-Arab persian/sample.txt
fa-Arab-Dari persian/sample_dari.txt
fr-Latn french/sample.txt
ha-Latn hausa/sample.txt
he-Hebr hebrew/sample.txt
hi-Deva hindi/sample.txt
hy-Armn armenian/sample.txt
id-Latn indonesian/sample.txt
ja-Jpan japanese/sample.txt
ka-Geor georgian/sample.txt
kk-Cyrl kazakh/sample.txt
ku-Arab kurdish/sample.txt
ku-Latn kurdish/sample_latn.txt
ky-Cyrl kyrgyz/sample.txt
mr-Deva marathi/sample.txt
pa-Arab punjabi/sample.txt
pcm-Latn nigerian_pidgin/sample.txt
pt-Latn portuguese/sample.txt
ps-Arab pashto/sample.txt
ru-Cyrl russian/sample.txt
sw-Latn swahili/sample.txt
te-Telu telugu/sample.txt
tg-Cyrl tajik/sample.txt
tk-Cyrl turkmen/sample_cyrl.txt
tk-Latn turkmen/sample.txt
tr-Latn turkish/sample.txt
uk-Cyrl ukrainian/sample.txt
ur-Arab urdu/sample.txt
ug-Arab uyghur/sample.txt
ug-Latn uyghur/sample_latn.txt
ug-Cyrl uyghur/sample_cyrl.txt
ug-Latn-UYY uyghur/sample_yengi.txt
uz-Latn uzbek/sample.txt
uz-Cyrl uzbek/sample_cyrl.txt
vi-Latn vietnamese/sample.txt
sd-Arab sindhi/sample.txt
yi-Hebr yiddish/sample.txt
zh-Hani chinese/sample.txt
"""

# Cue words of each language, all its scripts together.
CUE_WORDS_TEXT = """
ar: في من أن على إلى أو لا هو هي هذا هذه الذي التي كل لكل كان بين دون
az: və bir hər hüququ malikdir ya heç bu ilə üçün öz olan deyil вә бир һәр һүгугуна маликдир ја һеч бу илә үчүн өз олан و کی ایله اوچون بیر او بو وار سونرا گؤره
bn: এবং ও এর এই একটি যে না জন্য থেকে হয় করে সঙ্গে মানুষ সব কোনো
de: der die das und in von zu den mit für ist auf nicht ein eine als auch werden
en: the of and to in or is are that this with for from shall has have not every all
es: de la que el en y a los se del las por un para con no una su al
fa: از آن این است با برای به بود در را که و هر همه هیچ یک خود شود دارد نیز
fr: de la le les des et à en un une du que est pour dans pas sur ce qui
ha: da na ne ni a cikin wani wannan ba ko ya ta su don kuma daga zuwa
he: של כל אדם או על את לא הוא היא זכאי החוק עם אם זה
hi: और के का में से को है हैं एक यह कि पर नहीं लिए भी कर हो
hy: ու ոք իրավունք ունի եւ կամ է իր յուրաքանչյուր այս ամեն ոչ չի են
id: yang dan di ke dari untuk dengan pada ini itu tidak adalah sebagai atau oleh dalam
ka: და უფლება აქვს ადამიანს ყველა ყოველ ან უნდა არ მისი თუ ამ
kk: және адам әр мен немесе құқығы бар өз арқылы тиіс тең осы ешкім
ku: لە و بە کە بۆ ئەو سەر دا بوو نییە û ku bi ji di li xwe hemû maf herkes kirin heye
ky: жана менен адам бир ар же укуктуу тийиш бардык өз эмес ээ эч үчүн
mr: आणि आहे आहेत मध्ये नाही यांच्या तसे मात्र करून म्हणून होती होते
pa: تے اے دا دی دے وچ ہر شخص توں یا کسے نوں کوئی اوہدے وی
pcm: dey di na wey dem don wetin sey sef con
pt: de a o que e do da em um para é com não uma os no se na por
ps: د په او چې له څوک شي وي نه هغه سره يا لري هر کښې کې يو یو دي ده
ru: и в во на не или что это как по из к с для он она имеет каждый человек никто
sd: جي هڪ کي جو کان آهي لاء سان تي ڪئي ڪرڻ جيڪو ڪندي ٿي هو
sw: na ya wa kwa katika ni kuwa au hii haki kila watu mtu si la za kutoka
te: మరియు యొక్క లో ఒక ఈ కు నుండి కోసం అని ఉంది కాదు వారు అన్ని లేదా
tg: ва дар ба ки ҳар як ё бо дорад аз инсон ҳақ ин шавад онҳо нест барои
tk: we bir adam her öz haklydyr ýa hem bu hiç deň üçin bilen ве бир адам хер өз хаклыдыр я хем бу хич дең үчин билен
tr: ve için ile olarak olan olduğu hak veya de da kendi hiç karşı daha çok tarafından
uk: і й та в у на не або що це як до з для він вона має кожна людина ніхто від
ur: کے کی کا اور میں سے کو ہے ہیں اس یا پر ہر نہیں جائے ایک کہ جو کوئی
ug: ۋە بىر ھەر ئىنسان ياكى بىلەن ئۇ بۇ ئۈچۈن بار ئەمەس ئۆز ھوقۇق قىلىش بولغان we bir her insan yaki bilen u bu üchün bar emes öz hoquq qilish bolghan вә һәр инсан яки билән үчүн әмәс өз һуқуқ қилиш болған wə ⱨər bilən üqün əməs ɵz ⱨoⱪuⱪ ⱪilix bolƣan
uz: va bir inson yoki har bilan egadir o'z mumkin barcha bo'lgan hech emas kim uchun bu ham o'zbekiston respublikasi ва бир инсон ёки ҳар билан эгадир ўз мумкин барча бўлган ҳеч эмас ким учун бу ҳам
vi: và của là có trong một được không cho với các những người này từ đến để
yi: און די דער אױף ניט זײ איז אין פֿון מיט צו דאָס
"""

# Weights of distinctive characters.
DISTINCTIVE_TEXT = """
ar: ة=2.3 أإ=0.4 آ=0.3
az: јҹҝ=3.2 ə=0.15
de: ß=3.0
en: w=1.1
es: ñ=3.0
fa: ۀ=3.0
fr: œ=3.0
ha: ɓɗƙ=3.2
kk: ұ=3.2 і=0.5 қғәңөү=0.35
ku: ێڕڵڤêîû=3.2 ۆ=0.35
ky: ңөү=0.35
mr: ळ=3.2
pt: ãõ=3.0
ps: ټځڅډړږښګڼېۍ=3.2 پچژ=0.5
ru: щ=0.5 ъ=0.3
sd: ڪٽڊڻٿڏڳڙٻڀڌڇڃٺڄڍ=3.2
tg: ӣҷӯ=3.0 ғқҳ=0.7
tk: ýňäž=3.2
uk: їєґ=3.2
ug: ڭۇۈۋ=3.2 ƣɵⱨⱪⱬ=4.0 ëé=2.2
uz: ў=6.0 ʻʼ=3.0 қғҳ=0.65 q=0.45 x=0.35
vi: ăđơư=3.2
yi: װױײ=3.5
"""

# Apostrophes that count as the plain one inside a word.
APOSTROPHES = "‘’ʻʼ`"

# The Uyghur Arabic alphabet, then Latin, Cyrillic and New Script; - is nothing.
UYGHUR_TEXT = """
ئ - - -
ا a а a
ە e ә ə
ب b б b
پ p п p
ت t т t
ج j җ j
چ ch ч q
خ x х h
د d д d
ر r р r
ز z з z
ژ zh ж ⱬ
س s с s
ش sh ш x
غ gh ғ ƣ
ف f ф f
ق q қ ⱪ
ك k к k
گ g г g
ڭ ng ң ng
ل l л l
م m м m
ن n н n
ھ h һ ⱨ
و o о o
ۇ u у u
ۆ ö ө ɵ
ۈ ü ү ü
ۋ w в w
ې ë е e
ى i и i
ي y й y
"""

# Languages of one script, for predictions without a script.
LANGUAGE_SCRIPTS_TEXT = """
ar=Arab bn=Beng de=Latn en=Latn es=Latn fa=Arab fr=Latn ha=Latn he=Hebr hi=Deva hy=Armn id=Latn ja=Jpan ka=Geor kk=Cyrl ky=Cyrl mr=Deva pa=Arab pcm=Latn pt=Latn ps=Arab ru=Cyrl sd=Arab sw=Latn te=Telu tg=Cyrl tr=Latn uk=Cyrl ur=Arab vi=Latn yi=Hebr zh=Hani
"""

# Spellings of script names.
SCRIPT_ALIASES_TEXT = """
arab=Arab arabic=Arab armn=Armn armenian=Armn beng=Beng bengali=Beng cyrl=Cyrl cyrillic=Cyrl deva=Deva devanagari=Deva geor=Geor georgian=Geor han=Hani hani=Hani hebr=Hebr hebrew=Hebr japanese=Jpan jpan=Jpan latn=Latn latin=Latn telu=Telu telugu=Telu
"""


def _pairs(text: str) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in text.strip().split("\n"))


def _equal(text: str) -> dict[str, str]:
    return dict(item.split("=") for item in text.split())


SCRIPT_NAMES = _pairs(SCRIPT_NAMES_TEXT)
LANGUAGE_NAMES = _pairs(LANGUAGE_NAMES_TEXT)
CUES = {k: v.split() for k, v in _pairs(CUE_WORDS_TEXT).items()}
DISTINCTIVE = {
    language: {c: float(weight) for chars, _, weight in (item.rpartition("=") for item in text.split()) for c in chars}
    for language, text in _pairs(DISTINCTIVE_TEXT).items()
}
#: (profile key, language, script, path of the sample below a corpus folder)
PROFILES = [(key, key.split("-")[0], key.split("-")[1], path) for key, path in (line.split() for line in PROFILES_TEXT.strip().split("\n"))]
UYGHUR = [tuple("" if x == "-" else x for x in line.split()) for line in UYGHUR_TEXT.strip().split("\n")]
LANGUAGE_SCRIPTS = _equal(LANGUAGE_SCRIPTS_TEXT)
SCRIPT_ALIASES = _equal(SCRIPT_ALIASES_TEXT)


def unique_cues() -> dict[str, set[str]]:
    """Cue words that one language alone has, whatever the script."""
    owners: dict[str, int] = {}
    for cues in CUES.values():
        for word in set(cues):
            owners[word] = owners.get(word, 0) + 1
    return {language: {w for w in cues if owners[w] == 1} for language, cues in CUES.items()}
