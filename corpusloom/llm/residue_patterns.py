"""What publishing systems and web servers leave in place of text, as trusted patterns.

MESSAGES are matched at the start of a folded segment (lower case, accents stripped, quoted spans and codes masked).
SLOTS are matched anywhere in the text outside code quotes.
"""

#: Unfilled template slots.
SLOTS = [
    r"\{\{[^{}\n]{1,120}\}\}",
    r"\$\{[^{}\n]{1,80}\}",
    r"#\{[^{}\n]{1,80}\}",
    r"\{%[^%{}\n]{1,120}%\}",
    r"<%[^%\n]{1,120}%>",
    r"<\?(?:php|=)[^\n]{1,200}?\?>",
    r"<!--[^\n]{0,120}?-->",
    r"\$\$[A-Z][A-Z_]{1,40}\$\$",
    r"%%[A-Z][A-Z_]{1,40}%%",
    r"@@[A-Z][A-Z_]{1,40}@@",
    r"\|\*?[A-Z][A-Z_]{2,40}\*?\|",
    r"__[A-Z]{2,}(?:_[A-Z]+)*__",
    r"%\([a-z_]{1,40}\)[sdrif]",
    r"\{\*[a-z_ ]{1,60}\*\}",
    r"\[\[[\w.]{1,60}\]\]",
    r"\{\d{1,2}\}",
    r"<<[^\W\d_][\w .\-]{0,40}>>",
    r"««[^\W\d_][\w .\-]{0,40}»»",
    r"\[object Object\]",
    r"<(?:INSERT|ENTER|ADD|YOUR|PLACE|FILL)\b[^<>\n]{0,60}>",
    r"\[[A-ZÀ-ÖØ-Þ]{2,}(?:[ _][A-ZÀ-ÖØ-Þ]{2,})+\]",
    r"\[(?:Name|Title|Number|Date|Place|City|Amount|Quote|Age) of [^\[\]\n]{1,40}\]",
    r"\[[^\[\]\n]{0,40}\b(?:einsetzen|einf[üu]gen|eintragen|erg[äa]nzen|completar|insertar|rellenar|ins[ée]rer|compl[ée]ter|inserire|inserisci|wstaw|uzupe[łl]nij|ekleyin|doldurun|masukkan|sisipkan|isi di sini|вставить|вставьте|TBD|TODO|goes here|to come)\b[^\[\]\n]{0,30}\]",
    r"\bTK(?: TK)+\b",
    r"\bX{3,}(?: \(fill in\))",
    r"\bX{4,}\b",
    r"\bundefined\b(?! (?:behaviou?r|term|variable|role|period|number|amount|by|in law))",
]

#: Messages of servers and applications, script notices and filler, by language; {x} stands for any short run of text.
MESSAGES = [
    # script notices
    r"please (?:enable|activate|turn on|allow) (?:javascript|js|scripts?|cookies)\b",
    r"(?:you need|you have) to enable (?:javascript|scripts?|cookies)",
    r"(?:javascript|scripts?|js) (?:is|are|must be) (?:required|disabled|not enabled|turned off|enabled to)",
    r"(?:turn on|enable) (?:javascript|scripts?)\b",
    r"this (?:page|site|website|app|application) (?:works best with|requires|needs) (?:javascript|scripts?)",
    r"we(?: have|'ve)? detected that (?:js|javascript|scripts?)",
    r"loading {x}(?:allow|enable) (?:javascript|scripts)",
    r"if nothing happens,? (?:please )?(?:allow|enable)",
    r"bitte (?:aktivieren|erlauben) sie (?:javascript|skripte)",
    r"diese (?:anwendung|seite|website) (?:benotigt|erfordert|braucht) {x}(?:javascript|skript)",
    r"(?:veuillez|merci d'?) ?activer (?:javascript|les scripts)",
    r"(?:les scripts|javascript) (?:doivent|doit) etre",
    r"activez javascript",
    r"(?:active|habilite|por favor,? active) (?:javascript|los scripts)",
    r"esta (?:pagina|aplicacion|web) (?:necesita|requiere) {x}(?:scripts?|javascript)",
    r"(?:abilita|attiva)(?:re)? (?:javascript|gli script)",
    r"servono gli script",
    r"questa (?:pagina|applicazione) richiede {x}(?:javascript|script)",
    r"aktifkan (?:javascript|skrip)",
    r"halaman ini (?:membutuhkan|memerlukan) {x}(?:javascript|skrip)",
    r"{x}icin lutfen javascript",
    r"lutfen javascript",
    r"bu (?:sayfa|uygulama) {x}(?:javascript|betik)",
    r"włacz (?:javascript|skrypty|obsługe)",
    r"ta (?:strona|aplikacja) wymaga {x}(?:javascript|skrypt)",
    r"включите (?:javascript|скрипты)",
    r"для (?:работы|просмотра) {x}(?:javascript|скрипт)",
    r"ενεργοποιηστε {x}javascript",
    r"(?:कृपया )?{x}जावास्क्रिप्ट",
    r"{x}javascript (?:सक्षम|चालू)",
    r"(?:请|請)(?:启用|啟用|开启|開啟|打开|允许)",
    r"{x}(?:启用|开启)\s?(?:javascript|脚本)",
    r"{x}javascript\s?を?有効",
    r"{x}スクリプトを(?:有効|許可)",
    # missing pages, refused access, server trouble
    r"(?:error:? )?(?:http )?(?:4\d\d|5\d\d)(?: error)?\W{{1,4}}{x}(?:not found|not be found|forbidden|bad gateway|server error|unavailable|time-?out|unauthorized|bad request|gone)",
    r"(?:4\d\d|5\d\d) (?:not found|forbidden|bad gateway|internal server error|service unavailable|gateway time-?out|unauthorized|bad request|gone)",
    r"(?:page|file|article|story) not found\b",
    r"the (?:requested )?(?:page|url|file|document) {x}(?:not found|could not be found|does not exist|was not found)",
    r"access (?:denied|forbidden)\b",
    r"forbidden\W",
    r"you (?:do not|don't) have permission to (?:view|access)",
    r"this content is not available in your",
    r"service (?:is )?(?:temporarily )?unavailable",
    r"bad gateway",
    r"internal server error",
    r"gateway time-?out",
    r"too many requests",
    r"traceback \(most recent call last\)",
    r"(?:fatal|parse|runtime) error:? ",
    r"(?:uncaught|unhandled) (?:exception|error)",
    r"(?:database|connection) (?:connection )?(?:failed|error|refused)",
    r"error establishing a database",
    r"(?:your )?session {x}(?:expired|timed out)",
    r"(?:sorry,? )?something went wrong",
    r"(?:an )?(?:unexpected |unknown )?error (?:has )?occurred",
    r"this (?:article|page|content|story) is no longer available",
    r"(?:the|this|our) (?:site|website|service|server|page) {x}(?:is|are) (?:currently )?(?:down|offline|unavailable|under maintenance)",
    r"your (?:request|ip|access) {x}(?:was|has been|is) blocked",
    r"(?:complete|solve) the (?:check|captcha)",
    r"upstream (?:node|server|connect)",
    r"seite (?:wurde )?nicht gefunden",
    r"die (?:angeforderte )?seite {x}nicht (?:gefunden|existiert|verfugbar)",
    r"zugriff (?:verweigert|nicht erlaubt)",
    r"es ist ein {x}fehler aufgetreten",
    r"interner serverfehler",
    r"dieser (?:artikel|inhalt) ist nicht mehr verfugbar",
    r"erreur \d",
    r"(?:la )?page {x}(?:est )?introuvable",
    r"acces (?:refuse|interdit)",
    r"erreur (?:interne|du serveur|serveur)",
    r"ce contenu {x}n['’]est plus disponible",
    r"cet article n['’]est plus disponible",
    r"(?:la )?pagina {x}no (?:encontrada|existe|disponible)",
    r"pagina no encontrada",
    r"error (?:interno|del servidor|del server)",
    r"acceso denegado",
    r"el (?:contenido|articulo) {x}ya no esta disponible",
    r"(?:la )?pagina {x}non (?:trovata|esiste|disponibile)",
    r"accesso negato",
    r"errore (?:interno|del server)",
    r"(?:il contenuto|l'articolo) {x}non e piu disponibile",
    r"halaman {x}tidak ditemukan",
    r"akses ditolak",
    r"terjadi kesalahan",
    r"(?:konten|artikel) {x}tidak (?:lagi )?tersedia",
    r"aradiginiz sayfa",
    r"sayfa bulunamadi",
    r"sunucu hatasi",
    r"erisim (?:engellendi|reddedildi)",
    r"bu (?:icerik|haber) {x}artik",
    r"nie znaleziono strony",
    r"strona {x}nie (?:istnieje|została znaleziona)",
    r"bład (?:serwera|wewnetrzny)",
    r"odmowa dostepu|dostep zabroniony",
    r"страница {x}не наидена",
    r"(?:внутренняя )?ошибка сервера",
    r"доступ (?:запрещен|закрыт)",
    r"(?:этот )?материал {x}(?:больше )?недоступен",
    r"η σελιδα {x}δεν βρεθηκε",
    r"σφαλμα (?:διακομιστη|του διακομιστη)",
    r"(?:δεν επιτρεπεται η|αρνηση) προσβαση",
    r"पृष्ठ {x}नहीं मिला",
    r"सर्वर त्रुटि",
    r"(?:पहुँच|प्रवेश) (?:अस्वीकृत|निषिद्ध)",
    r"(?:服务器|伺服器|系统)(?:内部)?(?:错误|錯誤|出错)",
    r"(?:找不到|未找到){x}(?:页面|頁面|网页)",
    r"(?:页面|网页|頁面){x}(?:不存在|未找到|找不到)",
    r"(?:访问被拒绝|拒绝访问|禁止访问)",
    r"(?:内部)?サーバーエラー",
    r"(?:お探しの)?ページ{x}(?:見つかりません|存在しません)",
    r"アクセス(?:が拒否|権限)",
    # filler
    r"placeholder (?:paragraph|text|copy|content|headline)",
    r"this is (?:a )?(?:sample|dummy|placeholder|test) (?:text|paragraph|article|content)",
    r"(?:type|enter|insert|put|write) your {x}(?:text|story|content|headline) here",
    r"(?:your|the) (?:text|story|content) goes here",
    r"(?:hier steht|dies ist ein|das ist ein) {x}(?:blindtext|platzhalter|beispieltext)",
    r"(?:blindtext|platzhaltertext|beispieltext) (?:nr|nummer|#|\d)",
    r"(?:faux texte|texte (?:factice|d['’]exemple|de remplissage)) (?:#|\d|en attendant)",
    r"texto de (?:relleno|ejemplo|prueba)\b",
    r"testo (?:segnaposto|di esempio|riempitivo|di prova)\b",
    r"teks (?:contoh|pengganti|pengisi)\b",
    r"(?:ornek|yer tutucu|dolgu) metin",
    r"(?:tekst (?:zastepczy|przykładowy|probny)|przykładowy tekst)",
    r"(?:текст-заполнитель|пример текста|текст-рыба|здесь будет текст)",
    r"(?:κειμενο (?:κρατησης|δειγματος|συμπληρωσης)|δοκιμαστικο κειμενο)",
    r"(?:नमूना|उदाहरण) (?:पाठ|लेख)",
    r"(?:占位|示例|样本|测试)(?:文字|文本|内容|段落)",
    r"(?:ダミー|サンプル)(?:テキスト|文章|記事)",
    r"(?:test )+test\b|test test",
    r"(?:foo bar baz|bla bla bla|xxx xxx|tbd tbd)",
    r"(?:asdf|qwert[yz]|sdfg|hjkl)(?: (?:asdf|qwert[yz]|sdfg|hjkl))+",
]

#: Words of the usual filler paragraph.
LOREM = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore "
    "magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui "
    "officia deserunt mollit anim id est laborum"
).split()
