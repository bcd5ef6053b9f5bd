"""Dictionaries of answers: languages, ways to decline, stand-ins for no value."""

#: Frequent words of languages. A word of several lists tells each of them a part.
FUNCTION_WORDS = {
    "en": "the of and to is that for it with as are this be by at from or have not but they which you were would there their what can if all into only than its my our we his she these those some about when where who how why has been after before without between every each half either nobody here found more once does please a an in on so no do did done will was i he her him them then also could should must may very yet still because while until cannot your me us up out over under".split(),
    "de": "der die das und ist nicht ein eine einen einem einer eines zu dem den des auf für von sich auch nach wie bei aus wird werden sind haben hat ich du wir ihr über noch nur oder aber wenn weil dass bitte mir dir warum welche bevor hier davon gibt läuft keine kein mit wurde kann kannst zeig am im in an um bis dann danach deshalb darum daher also als es sie er ohne mal etwas möchte nennt passt besten mehr sehr schon doch jetzt durch gegen zum zur vom beim ins ans diese dieser dieses diesem diesen alle alles man niemand weiß".split(),
    "fr": "le la les un une des de du et est sont dans que qui quoi aux ce cet cette ces avec ne pas plus se il elle ils elles nous vous je tu mais où donc ni sa son ses leur leurs peux peut pourquoi quelles quel avant voici après garde étape sur au l d qu n s j c m t quand sans chez très était pour par en a à on y encore souvent bientôt si comme même aussi tout tous toute sait veut parle devient choisit mieux ici ont été être avoir fait venues personne puis".split(),
    "es": "el la los las un una unos unas y e o es son que por se su sus del al lo de en con no como más ya esta este esto estos estas porque entre cuando muy sin sobre también hasta hay donde qué quién desde nos aquí luego antes después resultado puedes cómo está están fue para a si sabe quiere saber algo así elige eso mejor nadie pero todo todos cada siempre habla veces hemos ha han ser estar hacer tiene uno le les me te mi tu sigue".split(),
    "it": "il lo la i gli le un uno una di del della dei degli delle è e o che chi per non sono nel nella nei con su da dal dalla questo questa questi come più ma dopo prima quando dove perché ho ha hanno ecco ogni senza alla al ai anche se si mi ti ci vi suo sua loro io tu noi molto tutto tutti essere fare così già ancora".split(),
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas e é que não por para com se seu sua ao aos à às como mais mas depois antes quando onde porque são foi está estão aqui cada nenhum pelo pela este esta isto isso você eu ele ela nós eles também já muito todo todos sem sobre até entre ser ter fazer".split(),
    "nl": "het de een en van ik je jij hij zij wij we dat die niet is zijn op te voor met aan er maar om dan zou wat wordt worden bij ook naar uit heeft hebben had dit deze waarom welke voordat geen nog in als of over door tot nu hier daar kan kunnen moet wil mijn zijn haar ons alle alles iets niets heel zo".split(),
    "sv": "och att det som en ett på är av för med den till inte om har de jag du vi han hon men var sig så från vi kan när hur eller ska skulle också efter innan utan mycket här där vad varför vilka denna detta alla bara nu något några mot under över får blir blev mig dig oss min din är finns".split(),
    "da": "og at det som en et på er af for med den til ikke om har de jeg du vi han hun men var sig så fra kan når hvor eller skal ville også efter før uden meget her der hvad hvorfor hvilke denne dette alle kun nu noget nogle mod under over får bliver blev mig dig os min din".split(),
    "no": "og at det som en et på er av for med den til ikke om har de jeg du vi han hun men var seg så fra kan når hvor eller skal ville også etter før uten mye her der hva hvorfor hvilke denne dette alle bare nå noe noen mot under over får blir ble meg deg oss min din".split(),
    "pl": "i w na z że się do nie to jest jak o ale po co tak za od przez dla są już tym czy tylko być może ten ta te jego jej ich był była było gdy które który która oraz lub ze więc mnie mi cię pan pani bardzo jeszcze tutaj tego tej przed bez pod nad więcej".split(),
    "cs": "a v na s že se do ne to je jak o ale po co tak za od pro jsou už tím jen být může ten ta ty jeho její jejich byl byla bylo když který která které nebo ze proto mě mi tě velmi ještě zde toho této před bez pod nad více není".split(),
    "fi": "ja on ei se että en oli hän mutta joka kun niin kuin tämä ovat myös vain sen ole minä sinä me te he voi jos tai ennen jälkeen ilman hyvin tässä siellä mitä miksi kaikki nyt jotain vielä".split(),
    "hu": "a az és hogy nem is egy ez volt de van meg csak már ha mint vagy még ki fel én te mi ők nagyon itt ott miért mit mert minden kell lehet előtt után nélkül".split(),
    "tr": "ve bir bu da de için ile çok ne daha gibi kadar ama var yok ben sen biz siz onlar değil olarak olan sonra önce her şey neden nasıl ya mi mu en".split(),
    "ro": "și de la în nu că este un o cu pe pentru din se care mai sunt dar au fost ca prin sau după înainte fără foarte aici acolo ce cum unde când toate tot acest această eu tu noi voi".split(),
}
#: Words of short commands that tell an English prompt.
COMMANDS = "list show describe status items item workflow help run next step edit explain approve rewind summarize load recent export open start stop delete create find search update print save".split()
#: Blocks of letters that tell a script.
SCRIPTS = (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ"), ("hebrew", "֐", "׿"), ("arabic", "؀", "ۿ"), ("devanagari", "ऀ", "ॿ"), ("thai", "฀", "๿"), ("kana", "぀", "ヿ"), ("han", "一", "鿿"), ("hangul", "가", "힣"))

#: Texts that stand for no value, without punctuation and in lower case.
STAND_INS = set(
    "null|none|nil|nan|na|n a|nvt|undefined|undef|empty|blank|void|missing|tbd|todo|no value|no response|no answer|no output|no content|no text|no data|no result|no reply|nothing|not provided|not specified|unspecified|not available|not applicable|not set|unset"
    "|keine angabe|keine|kein wert|leer|nichts|nicht verfügbar|sin respuesta|sin valor|ninguno|ninguna|nada|nulo|vacío|vacio|no disponible|aucun|aucune|vide|rien|néant|non disponible|nessuno|vuoto|nenhum|vazio|geen|leeg".split("|")
)

#: Ways to decline, by language. ``self`` names the assistant, ``deny`` takes an ability, a
#: leave or the will away, ``act`` is what an assistant does for someone, ``ask`` what someone asks of it,
#: ``decline`` says no by itself, ``rule`` is what forbids, ``against`` sets a thing off from it, ``phrase``
#: declines whoever says it, ``whole`` as a sentence by itself; ``report`` tells why something didn't work out. A star stands for any ending.
DECLINING = {
    "en": {
        "self": "i|i'm|i'd|i'll|i've|we|we're|we'd|we'll|me|my|us|our|myself|assistant|ai|model|bot",
        "deny": "can't|cannot|can not|couldn't|won't|will not|wouldn't|would not|unable|not able|not allowed|not permitted|not authorised|not authorized|not free|not at liberty|not in a position|not comfortable|not going to|not willing|not prepared|not supposed|not meant|not equipped|rather not|prefer not|prefer to not|better not|may not|must not|shouldn't|should not|mustn't|do not|don't|am not|i'm not|is not|isn't|not something|not be|not one|no way|nothing i|never|refrain from|let us not|let's not|not let|not allow|not permit|not for",
        "act": "help*|assist*|answer*|respond*|reply*|replying|comply*|fulfil*|discuss*|comment*|engag*|support you|provide*|providing|share*|sharing|give|giving|go there|go into|talk about|speak about|say more|do so|do that|do this|doing that|doing this|doing so|carry out|carrying out|carry that out|take on|taking on|take part|handle|address|weigh in|touch|get into|be able to do|grant|serve|oblige|complete|honour|honor|accommodate|satisfy|respond to|process your",
        "ask": "request*|question|query|message|topic|subject|matter|prompt|inquiry|enquiry|demand|task|for you|with this|with that|on this|on that|this one|that one|of you|yours",
        "decline": "decline|declining|refuse|refusing|turn down|turn it down|turn this down|turn that down|turning down|turn you down|say no|pass on|pass up|abstain|opt out|bow out|sit this one out|skip this one|stop here|stop there|leave it there|leave it at that|unanswered|step aside|stay out of|steer clear|hold back|have to pass|must pass|back out|withhold|withholding|reject your|count me out|have to say no|take a pass",
        "rule": "guideline|guidelines|policy|policies|rule|rules|programming|scope|remit|principle|principles|instructions|values|terms|mandate|ethics",
        "against": "against|beyond|outside|outside of|violat*|contrary|conflict*|forbid*|prohibit*|prevent*|keep me|keeps me|stop me|stops me|bar me|bars me|rule out|rules out|do not|don't|does not|doesn't|not allow|exceed*|breach*",
        "whole": "no comment|i pass|i decline|count me out",
        "phrase": "off limits|no comment on|no comment about|no comment from|lips are sealed|not for me to say|not for me to judge|not my place|need a human|needs a human|ask a human|ask someone else|something else instead|ask about something else|ask me about something else|talk about something else|wrong of me|inappropriate for me|not appropriate for me|improper of me|unwise of me|irresponsible of me|what i am permitted|what i am allowed|what i'm permitted|what i'm allowed|what i may|what i can discuss|what i can do for|an assistant like me should|should not be answered by|let us not go|let's not go|nothing i can help|nothing i can do for|no i won't|no can do",
        "report": "is blocked|are blocked|still blocked|was blocked|is missing|are missing|not found|find|locate|does not exist|doesn't exist|do not exist|yet|until|failed|not exist|not see any|has not run|not finished|no item*|no such|error",
    },
    "de": {
        "self": "ich|mir|mich|mein*|wir|uns|unser*|assistent*|ki|sprachmodell",
        "deny": "nicht|kein*|nichts|nie|niemals|unmöglich|außerstande|ungern|weder",
        "act": "helf*|weiterhelf*|behilflich|antwort*|beantwort*|erfüll*|nachkomm*|äußer*|kommentier*|unterstütz*|bearbeit*|besprech*|sprechen|reden|mitteil*|auskunft|erlaubt|gestattet|möglich|befugt|berechtigt|in der lage|dienen|dienlich|tun|machen|übernehmen|ausführ*|liefern|weitergeben|sagen|geb*|stellung",
        "ask": "anfrage|frage|bitte|anliegen|wunsch|thema|nachricht|darüber|dazu|dabei|damit|hierbei|hierzu|dies*|das",
        "decline": "ablehn*|lehne|lehnen|verweiger*|weigere|weigern|zurückweis*|weise|absag*|passen|verzichte|verzichten|enthalte|abweisen|absehen|nein sagen|unbeantwortet",
        "rule": "richtlinie*|regel*|vorgabe*|grundsätz*|befugnis*|auftrag*|programmierung|prinzipien",
        "against": "gegen|außerhalb|verstößt|verstoßen|verbiet*|untersag*|widerspr*|erlauben|lassen|nicht",
        "whole": "kein kommentar|ich passe",
        "phrase": "kein kommentar zu|keinen kommentar|steht mir nicht zu|nicht meine aufgabe|tabu|ohne mich|da muss ich passen|ist mir untersagt|ist mir verboten",
        "report": "gefunden|finden|blockiert|fehlt|fehlen|noch nicht|existiert|kein element|vorhanden|solange|konnte nicht",
    },
    "fr": {
        "self": "je|j|me|m|moi|mon|ma|mes|nous|notre|nos|assistant*|ia",
        "deny": "pas|impossible|ni|jamais|aucun*|rien|incapable|interdit*|ne puis|ne saurais",
        "act": "aider|aide|répondre|réponds|réponse|commenter|discuter|parler|traiter|satisfaire|donner|fournir|partager|assister|autoris*|habilit*|permis|en mesure|faire|exécuter|accéder|donner suite|aborder|prononcer|possible|livrer|dire|entrer",
        "ask": "demande|question|requête|sujet|message|cela|ça|ceci|sur ce point|là-dessus|y",
        "decline": "refuse|refuser|décline|décliner|abstenir|abstiens|passer mon tour|passe mon tour|rejeter|renonce|renoncer|dire non|sans réponse",
        "rule": "règle*|principe*|consigne*|directive*|instruction*|politique*|charte|déontologie",
        "against": "contre|contraire*|hors|dehors|interdi*|empêch*|viole*|permett*|dépasse*|ne|n|sort",
        "whole": "aucun commentaire|pas de commentaire|sans commentaire|je passe",
        "phrase": "aucun commentaire sur|pas de commentaire sur|aucun commentaire de ma part|sans moi|ce n est pas à moi|hors limites|adressez vous à un humain|m est interdit|m est pas permis|m est impossible|ne m est pas",
        "report": "trouv*|bloqué*|manque*|pas encore|introuvable*|existe*|tant que|pas vu|vois pas|vois aucun*",
    },
    "es": {
        "self": "yo|me|mí|mi|mis|puedo|podré|podría|debo|tengo|quiero|deseo|pienso|prefiero|voy|estoy|soy|podemos|debemos|lamento|siento|nuestr*|asistente|ia",
        "deny": "no|imposible|nunca|jamás|tampoco|ningun*|incapaz|ni",
        "act": "ayud*|respond*|contest*|coment*|hablar*|atender*|proporcion*|asist*|decir*|dar*|hacer*|cumplir*|posible|permitid*|autorizad*|capacitad*|en condiciones|complacer*|entrar*|opinar*|facilit*|compartir*|tratar*|resolver*|realizar*|pronunciar*",
        "ask": "petición|solicitud|pregunta|consulta|tema|mensaje|eso|esto|ello|asunto",
        "decline": "rechazar*|rechazo|declin*|negarme|niego|niegue|rehúso|rehusar*|abstener*|abstengo|paso de|decir que no|sin respuesta|desestim*",
        "rule": "norma*|regla*|principio*|directri*|instruccion*|política*|pautas",
        "against": "contra|fuera|prohíb*|impid*|permit*|viol*|contrari*|no|exced*",
        "whole": "sin comentarios|ningún comentario|paso",
        "phrase": "sin comentarios sobre|sin comentarios por mi|ningún comentario sobre|no me corresponde|está vedado|conmigo no cuentes|me está prohibido",
        "report": "encontr*|bloquead*|falta|faltan|todavía no|aún no|existe*|hasta que|hallar*",
    },
    "it": {
        "self": "io|mi|me|mio|mia|mie|miei|posso|potrò|devo|sono|voglio|preferisco|possiamo|assistente",
        "deny": "non|impossibile|mai|nessun*|nulla|niente|né",
        "act": "aiut*|rispond*|commentare|discutere|fornire|farlo|fare|dare|parlare|in grado|autorizzat*|permesso|possibile|assist*|soddisf*|eseguire|dire",
        "ask": "richiesta|domanda|argomento|messaggio|questo|ciò",
        "decline": "rifiut*|declin*|astener*|astengo|dire di no|rinunci*",
        "rule": "regole|principi|linee guida|politiche|istruzioni",
        "against": "contro|fuori|viet*|proibi*|permett*|consent*|non|viol*",
        "whole": "no comment|nessun commento",
        "phrase": "senza di me",
        "report": "trova*|trovat*|bloccat*|manca*|ancora|esiste",
    },
    "pt": {
        "self": "eu|me|mim|meu|minha|meus|minhas|tenho|temos|posso|poderei|devo|sou|estou|quero|prefiro|podemos|assistente",
        "deny": "não|impossível|nunca|nenhum*|nada|nem",
        "act": "ajud*|respond*|comentar|discutir|fornecer|fazer|dar|falar|capaz|autorizad*|permitid*|possível|atender|cumprir|dizer",
        "ask": "pedido|pergunta|assunto|mensagem|isso|isto",
        "decline": "recus*|declin*|negar*|nego|abster*|abstenho|dizer não|rejeitar",
        "rule": "regras|princípios|diretrizes|políticas|instruções|normas",
        "against": "contra|fora|proíb*|imped*|permit*|viol*|não",
        "whole": "sem comentários",
        "phrase": "comigo não",
        "report": "encontr*|bloquead*|falta|ainda|existe",
    },
    "nl": {
        "self": "ik|mij|me|mijn|wij|we|ons|onze|assistent",
        "deny": "niet|geen|niets|nooit|onmogelijk|liever niet",
        "act": "help*|helpen|antwoord*|beantwoord*|geven|bespreken|ondersteun*|voldoen|doen|zeggen|reageren|toegestaan|in staat|bevoegd|mogelijk",
        "ask": "verzoek|vraag|onderwerp|bericht|dit|dat|hiermee|daarmee|hierop",
        "decline": "weiger*|afwijz*|wijs|bedank|afslaan|sla|onthouden|onthoud|nee zeggen",
        "rule": "regels|richtlijn*|beleid|principes|instructies",
        "against": "tegen|buiten|verbied*|verhinder*|staan|niet|in strijd",
        "whole": "geen commentaar",
        "phrase": "niet aan mij",
        "report": "vinden|gevonden|geblokkeerd|ontbre*|nog niet|bestaat",
    },
    "sv": {
        "self": "jag|mig|min|mina|vi|oss|våra",
        "deny": "inte|ej|aldrig|ingen|inga|omöjligt",
        "act": "hjälp*|svara*|besvara*|ge|diskutera|kommentera|göra|uppfylla|säga|tillåt*|möjlighet",
        "ask": "begäran|fråga*|ämne*|meddelande*|detta|det|den|önskemål",
        "decline": "avböj*|vägra*|avstå*|tacka nej|neka*|avslå",
        "rule": "riktlinjer|regler|policy|principer|instruktioner",
        "against": "mot|utanför|förbjud*|strider|hindra*|tillåter",
        "whole": "inga kommentarer",
        "phrase": "inte min sak",
        "report": "hitta*|blockera*|saknas|ännu|finns",
    },
    "pl": {
        "self": "ja|mi|mnie|mój|moje|moich|mogę|muszę|jestem|będę|chcę|wolę|możemy",
        "deny": "nie|niemożliwe|nigdy|żadn*",
        "act": "pomóc|pomaga*|odpowiedzieć|odpowiada*|odpowiem|skomentować|udzielić|zrobić|rozmawiać|spełnić|w stanie|wolno|powiedzieć",
        "ask": "prośb*|pytani*|temat*|wiadomoś*|tym|tego|tę|to",
        "decline": "odmówić|odmawiam|odmawiamy|odrzucić|odrzucam|wstrzymać",
        "rule": "zasad*|wytyczn*|reguł*|instrukcj*",
        "against": "wbrew|sprzeczn*|poza|zabrania*|narusza*|pozwala*",
        "whole": "bez komentarza",
        "phrase": "nie moja rola",
        "report": "znaleźć|znalazł*|zablokowan*|brakuje|jeszcze|istnieje",
    },
}
