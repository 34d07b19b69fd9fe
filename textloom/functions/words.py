"""Word lists, patterns and limits that results depend on."""

STOPWORDS = (
    "the and for with that this from have has had are was were you your about into onto before after then than they them their there here what "
    "when where which while also como para pero porque esta este estos estas con del las los una unos que por sus mas menos hay ser son fue"
).split()
PROTECTED = (
    "not no never without must should shall cannot can't do don't dont avoid only always before after unless except if else throw return delete "
    "remove drop reset approve deny allow block nunca jamas sin debe debes evita evitar solo siempre antes despues excepto eliminar borrar rechazar permitir bloquear prohibido"
).split()
ACTIONS = "delete remove drop reset approve deny allow block return throw commit push merge deploy borrar eliminar aprobar rechazar permitir bloquear guardar ejecutar".split()
PLAIN_NEGATIONS = "not no never without nunca jamas sin".split()

CRITICAL_NEGATIONS = "no not never without cannot dont neither nor nunca jamás jamas sin tampoco ni".split()
BOOLEANS = "true false null undefined verdadero falso nulo".split()
DESTRUCTIVE = (
    "delete remove drop reset destroy erase purge truncate overwrite revoke deny block borrar eliminar destruir reiniciar purgar truncar sobrescribir revocar "
    "rechazar bloquear borra borre borrad elimina elimine eliminad destruye destruya reinicia reinicie purga purgue trunca trunque sobrescribe sobrescriba "
    "revoca revoque rechaza rechace bloquea bloquee"
).split()
IMPERATIVE = (
    "must should shall required only always avoid allow approve commit push merge deploy execute run write debe debes deberá debera solo solamente siempre "
    "evita evitar permite permitir aprobar guardar ejecutar haz haga hagan permita aprueba apruebe guarda guarde ejecuta ejecute escribe escriba"
).split()
CRITICAL_OPERATORS = (
    "= == === != !== < <= > >= && || ! + - * / % += -= *= /= ?? => := & | ^ ~ ++ -- << >> >>> ** **= %= &= |= ^= <<= >>= >>>= ??= &&= ||="
).split()

#: In this order: the first that fits is taken.
LONG_OPERATORS = ">>>= === !== **= <<= >>= ??= &&= ||= &= |= ^= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= ** >>> << >> :: := <> -> |> ...".split()
OPERATOR_CHARACTERS = "+-*/%=&|!<>?:~^"

CODE_EXTENSIONS = ".c .cc .cpp .cs .css .go .h .hpp .html .java .js .jsx .mjs .php .py .rb .rs .sh .sql .swift .ts .tsx .vue".split()
CALL_KEYWORDS = "if for while switch catch function".split()

#: White space of the text rules, as the inside of a character class.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

MAX_TEXT, MAX_QUERY, MAX_LABEL = 2_000_000, 2_000, 200
LONG_SPAN, SPAN, RECENT_MESSAGE = 240, 700, 900
MIN_SAVINGS, USAGE_EVENTS = 0.15, 500
ANCHORS, HANDLES, MESSAGES = 12, 8, 24
TOKEN_GRAM, TOKEN_WINDOW, CHARACTER_GRAM, CHARACTER_WINDOW = 5, 8, 4, 24
QUERY_FINGERPRINTS, DOCUMENT_FINGERPRINTS = 4_096, 50_000
CANDIDATES, VERIFIED, STOP_COUNT = 32, 16, 128
GRAM_BASE = 0x9E3779B185EBCA87
