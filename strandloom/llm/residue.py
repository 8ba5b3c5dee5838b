"""Problem 10: template residue, filler, error pages and script notices.

Method: message templates are mined with a fixed-depth prefix tree. A text is cut
into segments (lines and sentences); digits and marks are masked; a segment goes
down the tree by its number of words and its first words, and at the leaf joins the
template it agrees with, whose differing words become wild. Equal segments are
counted before they are shuffled, and a leaf takes them in one order, so templates do not
depend on the partitioning. Each template is classified once, and the verdict
goes back to the documents of its segments; where words are wild, each distinct
wording is judged on its own. Unresolved slots inside ordinary sentences are
detected on their own, from the syntax of the mark and the words around it.

A template is classified by features. A known message (``MESSAGES``) is enough. Any other
one must put together what such messages are made of in the same sentence: something that should be
there and its failure or absence, or scripts and the need of them (``composed``); and it
must have support of two kinds: it is short, it addresses its reader, it stands on lines of its
own, or it recurs (``RECURS`` segments) in the corpus. Only segments that no feature can make a case
are left out of the tree.

A message or mark that is quoted, is named as the subject of a sentence about
marks, or stands in code does not count.

Defined cases: null and blank texts are no cases; repeated ids give one row; texts
are searched whole, in any number of segments; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, partitions, spread
from .texts import strings_of_json, unescape, visible

DEPTH = 6
#: Share of equal words from which a segment joins a template.
AGREE = 0.7
#: Templates up to which a leaf is read from end to end; a larger one is searched through an index, which finds the same template.
COMPARED = 256
#: Segments from which a template recurs; words up to which one is short; words of a message.
RECURS, SHORT, LONGEST = 3, 9, 18
WILD = "<*>"

# --- What a message says --------------------------------------------------------------------
# (cue, verdict, pattern). The cue is a plain text, looked for first; every match of a pattern holds
# the cue of an entry with that pattern. A pattern that begins with ^ must begin a segment.

_REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|"
    "too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out"
)
_STATUS_CUES = [c for x in _REASONS.replace("(?:temporarily )?", "").split("|") for c in ([x.replace("-?", ""), x.replace("-?", "-")] if "-?" in x else [x])] + ["temporarily unavailable"]
_WHAT = r"(?:page|report|file|document|resource|record|url|link|content|notebook|site|article|view|app|viewer|map|website)"
MESSAGES: list[tuple[str, str, str]] = [
    # Error pages and failed access
    *[(cue, "error", rf"^(?:\W*)(?:error|http|http/\d\.\d|http error|http status|status|fehler|error code)?[\s:]*<?\d*>?[\s:–—-]*\b[45]\d\d\b[\s:–—|-]+(?:{_REASONS})") for cue in _STATUS_CUES],
    ("<title", "error", rf"<title>\s*(?:error\s*)?[45]\d\d\b[^<]*(?:{_REASONS})"),
    ("<h1", "error", rf"<h1>\s*(?:error\s*)?(?:[45]\d\d\W+)?(?:{_REASONS})"),
    ("type status report", "error", r"^type status report"),
    ("oops", "error", r"^oops\b"),
    *[(cue, "error", rf"^(?:\W*)(?:the |this |requested )*{_WHAT} (?:was |is |could )?not (?:be )?found") for cue in ("not found", "not be found")],
    ("page you", "error", r"\bthe page you (?:asked for|requested|are looking for|were looking for|tried to (?:open|reach))\b.{0,40}?\b(?:could not|cannot|can't|does not|doesn't|has been|was not|is not|no longer|might)"),
    ("requested", "error", rf"\bthe requested {_WHAT} (?:could not|cannot|was not|is not|does not|has been|no longer)"),
    ("has moved", "error", rf"\bthis {_WHAT} has moved or\b"),
    ("no longer available", "error", rf"^(?:sorry,? )?(?:this|the) {_WHAT} is no longer available"),
    ("could not be loaded", "error", rf"^(?:sorry,? )?(?:this|the) (?:\w+ )?{_WHAT} could not be loaded"),
    ("access denied", "error", r"^access denied\b"),
    ("permission to", "error", r"\byou (?:do not|don't) have (?:the )?permission to (?:view|access|open|see|read)\b"),
    ("not authori", "error", r"\byou are not authori[sz]ed to\b"),
    ("sign in", "error", r"^(?:please )?(?:sign|log) in (?:again )?to (?:continue|view|access|see)\b"),
    ("log in", "error", r"^(?:please )?(?:sign|log) in (?:again )?to (?:continue|view|access|see)\b"),
    ("session", "error", r"\byour session (?:has|was) (?:expired|ended|timed out)\b"),
    ("something went wrong", "error", r"\bsomething went wrong\b"),
    ("occurred", "error", r"\ban? (?:unexpected |unknown |internal )*error (?:has )?occurred\b"),
    ("error establishing", "error", r"\berror establishing a\b.{0,30}connection"),
    ("application error", "error", r"\bapplication error\s*[:–-]"),
    ("fatal", "error", r"\bfatal(?: error)?: "),
    ("could not connect", "error", r"^(?:error: )?could not connect to the (?:server|database|host)"),
    ("undefined", "error", r"\b(?:warning|notice|error): undefined (?:variable|index|property|function)\b"),
    ("traceback (most", "error", r"^traceback \(most recent call last\)"),
    ("uncaught", "error", r"\buncaught (?:\w*error|exception)\b"),
    ("parse error", "error", r"\bparse error: syntax error\b"),
    ("down for", "error", r"\bwe(?:'re| are) (?:currently )?down for\b.{0,20}maintenance"),
    ("under maintenance", "error", rf"^(?:this|the) {_WHAT} is (?:currently )?under maintenance"),
    ("temporarily unavailable", "error", rf"\b(?:this|the) (?:service|{_WHAT}) is temporarily unavailable"),
    ("try again", "error", r"^(?:please )?try again (?:later|in a)|\bplease try again later\b"),
    ("checking your browser", "error", r"\bchecking your browser\b"),
    ("verify", "error", r"\bverify (?:that )?you are (?:a )?human\b"),
    ("rate limit exceeded", "error", r"^(?:\W*)(?:api )?rate limit exceeded"),
    *[(f"connection {how}", "error", rf"^(?:\W*)(?:error: )?connection {how}") for how in ("timed out", "refused", "reset")],
    ("this site can", "error", r"\bthis site can.t be reached\b"),
    ("nicht gefunden", "error", r"\bseite (?:wurde |konnte )?(?:leider )?nicht gefunden\b"),
    ("unerwarteter fehler", "error", r"\bunerwarteter fehler (?:ist )?aufgetreten\b"),
    ("fehler ist aufgetreten", "error", r"\bein (?:interner |technischer )?fehler ist aufgetreten\b"),
    ("versuchen", "error", r"\b(?:bitte )?(?:versuchen sie es )?später (?:noch ?mal |erneut )versuchen\b|\bbitte (?:später )?erneut versuchen\b"),
    ("zugriff verweigert", "error", r"^zugriff verweigert"),
    ("sitzung ist abgelaufen", "error", r"\b(?:ihre|deine) sitzung ist abgelaufen\b"),
    ("serverfehler", "error", r"^(?:interner )?serverfehler"),
    ("nicht verfügbar", "error", r"\b(?:diese|die) (?:seite|website|anwendung) ist (?:derzeit |zurzeit |vorübergehend )?nicht verfügbar\b"),
    ("lo sentimos", "error", r"^lo sentimos\b"),
    ("página", "error", r"\bpágina (?:solicitada )?(?:no (?:existe|encontrada|disponible|se ha encontrado)|não (?:existe|encontrada))"),
    ("acceso denegado", "error", r"^acceso denegado"),
    ("ha ocurrido un error", "error", r"\bha ocurrido un error\b"),
    ("ocurrió un error", "error", r"\bocurrió un error\b"),
    ("se ha producido un error", "error", r"\bse ha producido un error\b"),
    ("su sesión", "error", r"\bsu sesión ha (?:caducado|expirado)\b"),
    ("inténtelo", "error", r"\binténtelo (?:de nuevo|más tarde)\b"),
    ("sayfa bulunamadı", "error", r"\bsayfa bulunamadı\b"),
    ("aradığınız", "error", r"^aradığınız\b.{0,40}(?:taşınmış|bulunamadı|silinmiş|mevcut değil)"),
    ("bir hata oluştu", "error", r"\bbir hata oluştu\b"),
    ("tekrar deneyin", "error", r"\blütfen (?:daha sonra )?tekrar deneyin\b"),
    ("erişim", "error", r"^erişim (?:engellendi|reddedildi)"),
    ("oturumunuz", "error", r"\boturumunuz(?:un süresi)? (?:doldu|sona erdi)\b"),
    ("page introuvable", "error", r"\bpage introuvable\b"),
    ("accès", "error", r"^accès (?:refusé|interdit)"),
    ("une erreur", "error", r"\bune erreur (?:inattendue )?(?:s'est produite|est survenue)\b"),
    ("session a expiré", "error", r"\bvotre session a expiré\b"),
    ("pagina non trovata", "error", r"\bpagina non trovata\b"),
    ("si è verificato un errore", "error", r"\bsi è verificato un errore\b"),
    ("ocorreu um erro", "error", r"\bocorreu um erro\b"),
    ("acesso negado", "error", r"^acesso negado"),
    ("pagina niet gevonden", "error", r"\bpagina niet gevonden\b"),
    ("страница не найдена", "error", r"страница не найдена"),
    ("ページが見つかりません", "error", r"ページが見つかりません"),
    ("页面不存在", "error", r"页面不存在"),
    # Scripts required
    ("javascript", "script", r"\b(?:enable|activate|turn on|switch on|allow) javascript\b"),
    ("javascript", "script", r"\bjavascript (?:is|has been|appears to be) (?:disabled|turned off|required|not enabled|not supported|blocked)\b"),
    ("javascript", "script", r"\bjavascript (?:must|needs to) be (?:enabled|on|activated)\b"),
    ("javascript", "script", r"\b(?:this|the) (?:\w+ )?(?:viewer|site|page|app|application|report|map|website|form|tool) (?:requires|needs|relies on|does not work without|doesn't work without) javascript\b"),
    ("enable script", "script", r"\b(?:need to|must|please) enable scripts?\b"),
    ("allow scripts", "script", r"\ballow scripts for this\b"),
    ("scripting", "script", r"\bbrowser does(?: not|n't) support scripting\b"),
    ("support javascript", "script", r"\bbrowser does(?: not|n't) support javascript\b"),
    ("browser settings", "script", r"\bturn it on in your browser settings\b"),
    ("loading the interactive", "script", r"\bloading the interactive (?:map|view|viewer|report|plot)\s*(?:\.\.\.|…)"),
    ("javascript", "script", r"\b(?:aktivieren sie|aktiviere|schalten sie) (?:bitte )?javascript\b|\bjavascript (?:ist deaktiviert|muss aktiviert|wird benötigt)"),
    ("javascript", "script", r"\b(?:active|activa|activar|habilite|habilita|habilitar) (?:el )?javascript\b|\bjavascript (?:está desactivado|es necesario)"),
    ("javascript", "script", r"\bjavascript.{0,3}i? (?:etkinleştirin|açın|etkinleştirmeniz)|\bjavascript (?:devre dışı|gerekli)"),
    ("javascript", "script", r"\b(?:activez|activer|veuillez activer) (?:le )?javascript\b|\bjavascript est (?:désactivé|nécessaire|requis)"),
    ("javascript", "script", r"\b(?:abilita|abilitare|attiva|attivare|ative|habilite o|ativar o|schakel) javascript\b"),
    ("javascript", "script", r"javascript\s*を有効|включите javascript|启用\s*javascript"),
    # Filler and notices that something is still to be written
    ("here", "filler", r"\b(?:your|insert|add|enter|type|put) (?:your |some |the )?(?:content|text|title|description|copy|summary) (?:goes |will go )?here\b"),
    ("will go here", "filler", r"\b(?:text|content|copy|description|summary)\b[\w ]{0,40} will go here\b"),
    ("placeholder", "filler", r"\b(?:this is )?placeholder (?:copy|text|content|paragraph)\b"),
    ("sample heading", "filler", r"\bsample heading\b"),
    ("sample subheading", "filler", r"\bsample subheading\b"),
    ("sample body text", "filler", r"\bsample body text\b"),
    ("replace this", "filler", r"\breplace this (?:paragraph|text|sentence|section|content|line) with\b"),
    ("todo", "filler", r"^\W*todo\b\s*[:–-]|\btodo: "),
    ("tbd", "filler", r"\btbd(?: tbd)+\b|^\W*tbd\W*$|: tbd\W*$"),
    ("to be", "filler", r"^\W*(?:this (?:section|part|text|page|paragraph|summary)\b[\w ]{0,30} |text |content |details? |summary )?(?:is |are |still )*to be (?:written|completed|filled in|added|announced|determined|supplied)\b"),
    *[(f"not {word}", "filler", r"\b(?:section|part|text|page|paragraph|summary|chapter|description) (?:has|have|is) not (?:yet )?(?:been )?(?:yet )?(?:written|available|filled|ready)\b") for word in ("yet", "been", "written", "available", "filled", "ready")],
    ("not been", "filler", r"\b(?:section|part|text|page|paragraph|summary|chapter|description) (?:has|have) not been (?:written|filled in|added|completed)\b"),
    ("coming soon", "filler", r"^\W*(?:content |more |details? |text )?coming soon\b"),
    ("to follow", "filler", r"^\W*(?:content|text|details?|summary|description) to follow\b"),
    ("under construction", "filler", rf"^\W*(?:this|the) {_WHAT} is under construction"),
    ("blah blah", "filler", r"\bblah blah\b"),
    ("in later", "filler", r"\bfill (?:this )?in later\b"),
    ("xx", "filler", r"(?:\bx{2,}\b[\s.,]*){4,}"),
    ("asdf", "filler", r"\basdf\w*\b"),
    ("qwerty", "filler", r"^\W*qwerty\w*\b"),
    *[(f"hier {verb}", "filler", rf"\bhier {verb}\b.{{0,25}}\btext\b") for verb in ("steht", "folgt", "kommt")],
    ("platzhalter", "filler", r"^\W*(?:dies ist ein )?platzhalter(?:text)?\b|\bdies ist (?:ein )?platzhalter"),
    ("blindtext", "filler", r"\bdies ist (?:ein )?blindtext"),
    *[(f"{what} folgt", "filler", rf"^\W*{what} folgt\b") for what in ("inhalt", "text", "beschreibung")],
    ("noch nicht", "filler", r"\b(?:abschnitt|text|inhalt) (?:ist|wurde) noch nicht (?:geschrieben|verfasst|vorhanden)\b"),
    *[(f"texto de {what}", "filler", rf"\btexto de {what}\b") for what in ("ejemplo", "relleno", "muestra")],
    ("aquí", "filler", r"\b(?:escriba|inserte|ponga|añada)\b.{0,20}\btexto aquí\b|\baquí (?:va|irá) el texto\b"),
    ("próximamente", "filler", r"^\W*próximamente\b"),
    ("metin", "filler", r"\bburaya\b.{0,15}\bmetin\b.{0,12}\b(?:gelecek|girin|yazın|ekleyin)\b|\börnek metin\b"),
    ("henüz", "filler", r"\b(?:bölüm|metin|içerik) henüz (?:yazılmadı|hazır değil|eklenmedi)\b"),
    ("texte", "filler", r"\btexte (?:d'exemple|à venir|de remplissage)\b|\b(?:saisissez|insérez) (?:votre|le) texte ici\b"),
    ("testo", "filler", r"\btesto (?:di esempio|segnaposto)\b|\binserire (?:il )?testo qui\b"),
    ("texto de exemplo", "filler", r"\btexto de exemplo\b"),
    ("seu texto aqui", "filler", r"\bseu texto aqui\b"),
    ("tekst hier", "filler", r"\b(?:uw|je) tekst hier\b"),
    ("voorbeeldtekst", "filler", r"\bvoorbeeldtekst\b"),
]


def folded(text: str) -> str:
    """Lower case; the letters that a pattern takes for each other whatever the case are one."""
    return text.lower().replace("i̇", "i").replace("ı", "i").replace("ſ", "s")


_COMPILED = [(folded(cue), verdict, re.compile(pattern, re.I)) for cue, verdict, pattern in MESSAGES]
_CUES = sorted({cue for cue, _, _ in _COMPILED})
_FINDER = ahocorasick.Automaton()
for _cue in _CUES:
    _FINDER.add_word(_cue, _cue)
_FINDER.make_automaton()

#: Stems of the usual mock Latin, with the vowels that vary in its variants.
_LATIN = re.compile(
    r"^(?:lor[eu]m|ipsa?u?m|dol[aeo]r\w*|sit\w{0,2}|sedo?|amet|amera|consec\w*|adipi?\w*|elit\w*|eiusm?\w*|tempor\w*|incidi?\w*|labor\w*|magna\w*|aliqu\w*|enim\w*|"
    r"minim\w*|venia\w*|quis\w*|nostr\w*|exerci\w*|ullam\w*|nisi|commod\w*|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|"
    r"proident|sunt|culpa|officia|deserunt|mollit|anim|tetur|ut|et|in|ad|ea|ex)$"
)

#: One of these is in every run of mock Latin.
_LATIN_STEM = re.compile(
    r"\b(?:lor[eu]m|ipsa?u?m|dol[aeo]r|situm|amet|amera|consec|adip|elit|eiusm|tempor|incid|labor|magna|aliqu|enim|minim|venia|quis|nostr|exerci|ullam|nisi|commod|duis|aute|irure|velit|esse|"
    r"cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|tetur)"
)

# --- What messages are made of -----------------------------------------------------------------

_THINGS = frozenset(folded(
    "page pages site website webpage file document resource url link address content contents section view viewer app application portal request session connection server service account "
    "text description summary abstract article paragraph access image login dashboard chapter entry gateway database network host "
    "seite webseite inhalt inhalte abschnitt datei dienst anfrage sitzung beschreibung zusammenfassung zugang zugriff verbindung "
    "página contenido sección archivo servicio solicitud sesión descripción resumen acceso conexión "
    "contenu fichier requête accès résumé rubrique connexion pagina contenuto sezione richiesta accesso servizio descrizione sessione "
    "conteúdo seção secção acesso serviço pedido sessão arquivo inhoud toegang bestand sectie beschrijving sessie verzoek "
    "sayfa içerik içeriği bölüm erişim dosya oturum açıklama strona strony treść dostęp plik sekcja usługa sesja opis "
    "страница страницы содержимое доступ раздел сайт файл сервис сессия описание sida sidan siden innehåll innehållet indhold innhold avsnitt filen sivua sivu sisältö stránka obsah oldal tartalom pagină conținut").split()
)
_FAILS = frozenset(folded(
    "cannot can't cant couldn't unable failed fails denied forbidden blocked refused expired unavailable missing removed deleted invalid restricted unauthorized unauthorised rejected crashed exceeded offline "
    "unreachable inaccessible prohibited suspended overloaded disconnected maintenance unresponsive moved interrupted "
    "verweigert abgelaufen gesperrt fehlgeschlagen unerreichbar verboten überlastet wartung denegado caducado expirado denegada caducada bloqueado bloqueada prohibido mantenimiento "
    "introuvable indisponible refusé expiré expirée interdit interdite bloqué inaccessible supprimé supprimée negato scaduto scaduta bloccato bloccata vietato inesistente irraggiungibile "
    "indisponível negado expirou bloqueada proibido geweigerd verlopen geblokkeerd verboden onbereikbaar bulunamadı bulunamıyor engellendi reddedildi doldu erişilemiyor "
    "zabroniony zablokowana zablokowany wygasła niedostępna niedostępny недоступна недоступен недоступно запрещён запрещен заблокирован истекла saknas avvisad nekad spärrad avvist nægtet").split()
)
_FAIL = re.compile(
    r"\bnot (?:\w+ )?(?:found|available|exist|reachable|load|loaded|authori[sz]ed|respond|responding|accessible|be \w+|open|displayed|shown|permitted|allowed|supported)\b|\bcan ?not\b|\bcould ?n.t\b|\bdo(?:es)?n.t exist\b|"
    r"\bno longer\b|\btimed? ?out\b|\bwent wrong\b|\btry (?:\w+ )?again\b|\bno (?:access|permission|connection|response)\b|\bnicht (?:\w+ )?(?:gefunden|verfügbar|erreichbar|geladen|vorhanden|erlaubt)\b|"
    r"\bno (?:se )?(?:\w+ )?(?:encontrad[ao]|encontró|disponible|existe|cargar|permitido)\b|\bnon (?:\w+ )?(?:trovat[ao]|disponibile|esiste|consentito|raggiungibile)\b|\bn.(?:existe|est) (?:pas|plus)\b|\bpas (?:été )?(?:trouvée?|disponible|autorisée?)\b|"
    r"\bnão (?:\w+ )?(?:encontrad[ao]|disponível|existe|permitido)\b|\bniet (?:\w+ )?(?:gevonden|beschikbaar|bereikbaar|toegestaan)\b|\bmevcut değil\b|\bnie (?:\w+ )?(?:znaleziono|znaleziona|istnieje|jest dostępn[ay])\b|"
    r"\bне (?:\w+ )?(?:найден\w*|доступн\w*|существует)\b|\b(?:inte|ikke) (?:\w+ )?(?:hittas|hittades|finns|tillgänglig|fundet|funnet|tilgængelig|tilgjengelig)\b|\b(?:hittades|finns|fundet|funnet) (?:inte|ikke)\b|\bei (?:löytynyt|löydy)\b|\bnebyla nalezena\b|\bnem található\b|\bnu (?:a fost găsită|există)\b",
    re.I,
)
_EMPTY = re.compile(
    r"\bnot yet\b|\bno (?:content|text|description|summary|data entered)\b|\bnothing (?:here|to see|has been \w+)\b|\bto be (?:added|written|completed|provided|supplied|filled|confirmed|decided)\b|\bpending\b|\bcoming (?:soon|shortly|later)\b|\bforthcoming\b|"
    r"\bunder construction\b|\bplaceholder\b|\bdummy\b|\bt\.?b\.?[dac]\b|\bto follow\b|\bnot been (?:\w+ )?(?:added|written|entered|provided|filled|completed|published|created)\b|\bis (?:still |currently )?empty\b|\bwill (?:be (?:added|written|available|provided|published|posted)|appear|follow)\b|"
    r"\b(?:goes|go) here\b|\b(?:intentionally )?left (?:blank|empty)\b|\bwork in progress\b|\b(?:add|insert|enter|type|write|put) (?:your|the|a|some) \w+(?: \w+)? here\b|\bwird noch\b|\bfolgt\b|\bnoch (?:nicht|kein\w*|leer)\b|\bin (?:Arbeit|Vorbereitung)\b|\bpendiente\b|\bpróximamente\b|"
    r"\bpor (?:completar|escribir|definir)\b|\baún no\b|\ben (?:construcción|construction)\b|\bà (?:venir|compléter|rédiger)\b|\bpas encore\b|\bda (?:completare|scrivere|definire)\b|\bin (?:arrivo|costruzione|aanbouw)\b|\bnon ancora\b|\bem (?:breve|construção)\b|\bainda não\b|\bbinnenkort\b|\bnog niet\b|"
    r"\byakında\b|\bhenüz\b|\bhazırlanıyor\b|\bwkrótce\b|\bjeszcze nie\b|\bw (?:budowie|przygotowaniu)\b|\bскоро\b|\bещё не\b|\bеще не\b|\bв разработке\b|\bkommer (?:snart|senare)\b|\bännu inte\b",
    re.I,
)
_SCRIPTS = re.compile(r"\b(?:java ?script\w*|ecmascript|scripts?|scripting|cookies|skript\w*|script's)\b", re.I)
_NEED = re.compile(
    r"\b(?:enabl\w+|activat\w+|turn\w* (?:\w+ )?on|switch\w* (?:\w+ )?on|turned off|switched off|allow\w*|requir\w+|disabled|needs?|needed|must|supports?|blocked|blocks|necessary|without|aktivier\w*|benötig\w*|erforderlich|deaktiviert|"
    r"erlaub\w*|habilit\w+|activ\w+|necesari\w+|requier\w+|nécessaire|désactivé|nécessite|autoris\w+|attiv\w+|abilit\w+|richie\w+|disattivat\w+|ativ\w+|necessário|exige|requer|inschakel\w*|vereis\w*|nodig|uitgeschakeld|etkin\w*|gerek\w*|kapalı|włącz\w*|wymaga\w*|wyłączon\w*|"
    r"включ\w*|требу\w+|отключ\w*|aktiver\w*|kräv\w*|krever|kræver)\b",
    re.I,
)
_ADDRESS = re.compile(r"\b(?:you|your|please|sorry|we|our|us|sie|ihre?r?|bitte|leider|usted|su|por favor|lo sentimos|vous|votre|veuillez|désolé|suo|tuo|prego|spiacenti|você|seu|sua|desculpe|uw|je|helaas|lütfen|üzgünüz|proszę|przepraszamy|пожалуйста|извините|вы|din|ditt|tyvärr|vänligen|beklager)\b", re.I)


def composed(segment: str) -> str | None:
    """What a message would be from what it is made of."""
    if len(segment.split(None, LONGEST)) > LONGEST:
        return None
    words = _WORDS.findall(folded(segment))
    if _THINGS.isdisjoint(words) and not _SCRIPTS.search(segment):
        return None
    # What quotes something or shows a mark talks about it.
    if len(words) < 2 or _QUOTED.search(segment) or SLOT.search(segment) or _CODE.match(segment) or _REPORTED.search(segment):
        return None
    if _SCRIPTS.search(segment) and _NEED.search(segment):
        return "script" if _BROWSER.search(segment) else None
    if _THINGS.isdisjoint(words):
        return None
    if not _FAILS.isdisjoint(words) or _FAIL.search(segment):
        return "error"
    return "filler" if _EMPTY.search(segment) else None


_BROWSER = re.compile(r"\bjava ?script|ecmascript|cookies|\bbrowser|navigat?eur|navegador|tarayıcı|przeglądar|браузер|webbläsare|\b(?:page|site|viewer|view)\b", re.I)


# --- Marks left unfilled ---------------------------------------------------------------------

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_. -][A-Za-z0-9]+){0,4}"
SLOT = re.compile(
    rf"\{{\{{\s*[#/!&]?{_NAME}(?:\s*\|\s*[\w:'\" ]+)*\s*\}}\}}|\{{%-?\s*{_NAME}[^%]{{0,60}}%\}}|\$\{{{_NAME}\}}|(?<![\w$])\$[A-Za-z]\w{{1,30}}\$(?![\w$])|"
    rf"@@{_NAME}@@|(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)|(?<![\w_])_{{4,}}(?![\w_])|<%[=-]?\s*{_NAME}\s*%>|<<{_NAME}>>|«[A-Za-z][a-z0-9]*(?:_[A-Za-z0-9]+)*»|"
    rf"\[(?:INSERT|ENTER|ADD|YOUR|PUT)\b[^\[\]]{{1,40}}\]|\[[A-Za-z][\w ]{{0,30}} goes here\]|\[(?:insert|enter|add|your)\b[^\[\]]{{1,40}}\]|<(?:your|insert|enter)\b[^<>]{{1,40}}>|<(?:[A-Za-z]+[ _])?(?:PLACEHOLDER|placeholder)>|"
    rf"\[object Object\]|#\{{{_NAME}\}}|%\([A-Za-z_]\w*\)[sdrf]|\{{[A-Za-z_]\w*![rsa]\}}|\bXXX {_NAME} XXX\b|(?<![\w{{$#%'\"])\{{\d{{1,2}}\}}(?![\w}}])|"
    rf"(?<![\w{{$#%])\{{[A-Za-z_][A-Za-z0-9_]*\}}(?![\w}}])|(?<![\w%])%[A-Z][A-Z_]{{2,30}}%(?![\w%])|\*\|[A-Z_:]+\|\*|%%[A-Za-z_]\w*%%|(?<!\w)##[A-Z][A-Z_]+##(?!\w)|"
    rf"\[\[[A-Za-z][\w ]{{0,30}}\]\]|\b(?:dear|hello|hi) (?:undefined|null|none|nan)\b",
)
_SLOT_CHARS = re.compile(r"\{|\$|@@|__|<%|<<|«|\[|<(?:your|insert|enter)|(?:PLACEHOLDER|placeholder)>|%|XXX|##|\*\||[Dd]ear |[Hh]i ")
# A word about marks must refer to the mark: stand before it, or before a list of marks that it ends.
_ABOUT_BEFORE = re.compile(
    r"\b(?:(?:placeholder|mark|marker|format string|query string|syntax|variable|token|macro|tag|literal|regex|pattern)s?(?:,? (?:named|called|written as|like|such as))?|"
    r"(?:template|launcher|script|program|runner|shell|parser|renderer|linter|exporter)s? (?:now |still |also |only )?(?:uses?|reads?|takes?|expects?|expands?|sets?|rejects?|replaces?)|"
    r"written as|write|echo|def|return|import|printf?)[\s:,(]*$",
    re.I,
)
_LISTED = re.compile(r"(?:\0\s*(?:,|and\b|or\b)+\s*)+$")
_ABOUT_AFTER = re.compile(
    r"^[^.!?]{0,40}\b(?:in the (?:page |summary )?template|is replaced|are replaced|was replaced|is filled|was filled|is still in (?:it|the)|stands for|is a (?:placeholder|variable|mark)|means|names the|at render time)\b",
    re.I,
)
_CODE = re.compile(r"^\s*(?:def |for \w+ in |if \w+ |print\(|import |from \w+ import|return |echo |#!|\$ |>>> |curl |sed |awk |export \w+=|\w+ = )")
_REPORTED = re.compile(r"\b(?:message|banner|notice|text|string|phrase|response|page|log|error) (?:'|\"|saying|reading|that (?:says|reads)|called|named)|\b(?:readers|users|we|they|clients?) (?:saw|got|received|reported)\b", re.I)
_QUOTED = re.compile(r"(?<![\w'])'[^'\n]{1,200}'(?!\w)|(?<![\w\"])\"[^\"\n]{1,200}\"(?!\w)|`[^`\n]{1,200}`|“[^”\n]{1,200}”|‘[^’\n]{1,200}’|„[^“”\n]{1,200}[“”]|«\s[^»\n]{1,200}\s»|«[^»\n]* [^»\n]*»")
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"')\]]?\s+|\n+")
_DIGITS = re.compile(r"\d")


def prepared(text: str) -> str:
    return strings_of_json(visible(unescape(text)))


def segments(text: str) -> list[str]:
    """Lines and sentences. Three dots end one too."""
    return [s for s in (p.strip() for p in _SENTENCE.split(text)) if s]


def has_slot(segment: str) -> bool:
    """Whether an unfilled mark stands where content should be."""
    if not _SLOT_CHARS.search(segment):
        return False
    if _CODE.match(segment):
        return False
    bare = _QUOTED.sub(lambda m: " " * len(m[0]), segment)
    for m in SLOT.finditer(bare):
        if m[0].startswith("____") and not re.search(r"\w", bare.replace("_", "")):
            continue
        if not _ABOUT_BEFORE.search(_LISTED.sub("", SLOT.sub("\0", bare[: m.start()]))) and not _ABOUT_AFTER.match(bare[m.end() :]):
            return True
    return False


def mock_latin(segment: str) -> bool:
    words = re.findall(r"[^\W\d_]+", segment.lower())
    return len(words) >= 5 and sum(1 for w in words if _LATIN.match(w)) >= 0.6 * len(words)


_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: What can stand before a message on its line: marks of a list or a reply, and a tag.
_LEAD = re.compile(r"^(?:\[[\w ]{1,20}\]\s+|(?:fwd?|re|aw|wg)\s*:\s*|[>*•–-]+\s+)+", re.I)


def one_word(segment: str) -> bool:
    """One word again and again, and nothing else."""
    start = segment.split(None, 2)
    if len(start) < 3 or start[0].strip(".,;!…").lower() != start[1].strip(".,;!…").lower():
        return False
    words = _WORDS.findall(folded(segment))
    return len(words) >= 4 and len(set(words)) == 1 and len(words[0]) >= 3


def cues(lowered: str) -> set[str]:
    return {cue for _, cue in _FINDER.iter(lowered)}


def classify(template: str) -> str | None:
    """What a template is: ``error``, ``script``, ``filler`` or None."""
    bare = _LEAD.sub("", SLOT.sub(" ", _QUOTED.sub(" ", template)))
    lowered = folded(bare)
    if one_word(bare):
        return "filler"
    if not any(c in lowered for c in _CUES):
        return "filler" if mock_latin(bare) else None
    for cue, verdict, pattern in _COMPILED:
        if cue in lowered and (m := pattern.search(bare)):
            if m.start() > 25 and _REPORTED.search(bare[: m.start()]):
                continue
            if _CODE.match(bare) and m.start() < 12:
                continue
            return verdict
    return "filler" if mock_latin(bare) else None


class Index:
    """Which templates of a leaf hold a word at a place. A template that agrees with a segment
    differs from it at no more than ``spare`` of the places where the leaf's templates can differ,
    so it is in all but ``spare`` of the lists of any of the segment's words there."""

    def __init__(self, leaf: list[list], free: list[int], spare: int):
        self.free, self.spare = free, spare
        self.held: list[dict[str, list[int]]] = [{} for _ in free]
        for number, template in enumerate(leaf):
            self.put(number, template[0])

    def put(self, number: int, words: list[str]) -> None:
        for place, held in zip(self.free, self.held):
            held.setdefault(words[place], []).append(number)

    def blank(self, number: int, place: int) -> None:
        """A word became wild. The list of that word keeps the template, which is compared as it is now."""
        self.held[self.free.index(place)].setdefault(WILD, []).append(number)

    def near(self, words: list[str]) -> list[int]:
        """The templates that can agree with a segment, in the order of the leaf."""
        lists = sorted((held.get(words[place], ()) for place, held in zip(self.free, self.held)), key=len)
        counts, taken, read = Counter(), 0, 0
        for numbers in lists:
            if taken > self.spare and len(numbers) > read:
                break
            counts.update(numbers)
            taken, read = taken + 1, read + len(numbers)
        return sorted(number for number, n in counts.items() if n >= taken - self.spare)


class Tree:
    """A fixed-depth prefix tree of message templates."""

    def __init__(self, depth: int = DEPTH, agree: float = AGREE):
        self.depth, self.agree = depth, agree
        self.leaves: dict[str, list[list]] = {}  # path -> [words, count, count of those on their own lines]
        self.indexes: dict[str, Index] = {}

    def path(self, words: list[str]) -> str:
        first = [WILD if _DIGITS.search(w) else w for w in words[: self.depth]]
        return "\x1f".join([str(len(words)), *first])

    def index(self, path: str, leaf: list[list]) -> Index | None:
        """The index of a large leaf, whose templates differ at no place that the path gives."""
        if path not in self.indexes:
            first, n = path.split("\x1f")[1:], len(leaf[0][0])
            spare = max((d for d in range(n + 1) if (n - d) / n >= self.agree), default=-1)
            free = [i for i in range(n) if i >= len(first) or first[i] == WILD]
            if len(free) > spare:  # else all agree
                self.indexes[path] = Index(leaf, free, spare)
        return self.indexes.get(path)

    def add(self, words: list[str], count: int = 1, alone: int = 0) -> tuple[str, list]:
        path = self.path(words)
        leaf = self.leaves.setdefault(path, [])
        index = self.index(path, leaf) if len(leaf) > COMPARED else None
        best, score = None, 0.0
        for number in range(len(leaf)) if index is None else index.near(words):
            same = sum(map(eq, leaf[number][0], words)) / len(words)
            if same > score:
                best, score = number, same
        if best is not None and score >= self.agree:
            template = leaf[best]
            for place, (a, b) in enumerate(zip(template[0], words)):
                if a not in (b, WILD):
                    template[0][place] = WILD
                    if index is not None:
                        index.blank(best, place)
            template[1] += count
            template[2] += alone
            return path, template
        leaf.append([list(words), count, alone])
        if index is not None:
            index.put(len(leaf) - 1, words)
        return path, leaf[-1]


_NUMBER = re.compile(r"(?<![\w</])\d+(?:[.,]\d+)*(?!\w)")
_STATUS = re.compile(r"[45]\d\d")


def masked(segment: str) -> list[str]:
    """Words with numbers masked, but for those that can be a status code."""
    return _NUMBER.sub(lambda m: m[0] if _STATUS.fullmatch(m[0]) else "<n>", segment).split()


def judged(words: str, count: int, alone: int) -> str:
    """The verdict on a template: ``words``, its segments, and how many of them are lines of their own."""
    if known := classify(words):
        return known
    support = (len(words.split()) <= SHORT) + bool(_ADDRESS.search(words)) + (2 * alone >= count) + (count >= RECURS)
    return (composed(words) or "") if support >= 2 else ""


def _mine(parts: Iterator[pd.DataFrame], key: str, text: str, everything: bool) -> Iterator[pd.DataFrame]:
    tree = Tree()
    for part in parts:
        rows = []
        for id_, raw in zip(part[key], part[text]):
            whole = prepared(raw)
            lowered = folded(whole)
            hit = cues(lowered)
            slots = _SLOT_CHARS.search(whole) is not None
            latin = _LATIN_STEM.search(lowered) is not None
            lines = {line.strip() for line in whole.split("\n")}
            for segment in segments(whole):
                if slots and has_slot(segment):
                    rows.append(("slot", id_, "", "", False))
                low = folded(segment)
                told = any(c in low for c in hit) or (latin and mock_latin(segment)) or one_word(segment) or composed(segment)
                if told or everything:
                    words = masked(segment)
                    rows.append(("document" if told else "segment", id_, tree.path(words), " ".join(words), segment in lines))
        yield pd.DataFrame(rows, columns=["kind", key, "path", "template", "alone"])


def _merge(path: str, leaf: list[tuple[str, int, int]]) -> list[tuple[str, str, str, str, int]]:
    """Templates of one leaf, merged and classified."""
    tree, owners = Tree(), []
    for template, n, alone in sorted(leaf, key=lambda r: (-r[1], r[0])):
        owners.append((template, tree.add(template.split(" "), n, alone)[1]))
    verdicts = {id(t): judged(" ".join(t[0]), t[1], t[2]) for own in tree.leaves.values() for t in own}
    # A word that became wild may have been the telling one, or stand where a pattern asks for no word: then what joined is judged by its own words.
    told = lambda template, t: judged(template, t[1], t[2]) if WILD in t[0] else verdicts[id(t)]
    return [(path, template, " ".join(t[0]), told(template, t), n) for (template, t), n in zip(owners, (r[1] for r in sorted(leaf, key=lambda r: (-r[1], r[0]))))]


def _merge_sorted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaf after leaf of rows sorted by path."""
    columns = ["path", "template", "merged", "verdict", "n"]
    path, leaf = None, []
    for part in parts:
        out = []
        for own, template, n, alone in zip(part["path"], part["template"], part["n"], part["alone"]):
            if own != path and leaf:
                out += _merge(path, leaf)
                leaf = []
            path = own
            leaf.append((template, int(n), int(alone)))
        yield pd.DataFrame(out, columns=columns)
    if leaf:
        yield pd.DataFrame(_merge(path, leaf), columns=columns)


def mined(df: DataFrame, key: str, text: str, everything: bool = False) -> DataFrame:
    """Segments that can be part of a verdict (with ``everything``, all), and documents with slots."""
    rows = spread(df.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull() & (F.trim(text) != "")))
    schema = f"kind string, {key} bigint, path string, template string, alone boolean"
    return rows.mapInPandas(lambda parts: _mine(parts, key, text, everything), schema)


def templates(rows: DataFrame) -> DataFrame:
    """``path``, ``template``, ``merged``, ``verdict`` and ``n`` (segments of the template before merging)."""
    seen = rows.where(F.col("kind") != "slot").groupBy("path", "template").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("alone"))
    # Short rows that take long: the planner would put them into one task.
    seen = seen.repartition(partitions(rows.sparkSession), "path").sortWithinPartitions("path")
    return seen.mapInPandas(_merge_sorted, "path string, template string, merged string, verdict string, n bigint")


def residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``verdict`` (slot, error, script, filler) of documents to exclude; a document can have several."""
    rows = cut_lineage(mined(df, key, text))
    verdicts = templates(rows).where(F.col("verdict") != "").select("path", "template", "verdict")
    by_template = rows.where(F.col("kind") == "document").join(verdicts, ["path", "template"]).select(key, "verdict")
    slots = rows.where(F.col("kind") == "slot").select(key, F.lit("slot").alias("verdict"))
    return by_template.unionByName(slots).distinct()
