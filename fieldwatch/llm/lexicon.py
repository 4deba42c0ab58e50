"""Word lists and context patterns of abusive, hateful and sexually explicit language (fixed values, own compilation).

Words are written without accents, in lower case, as the matcher levels them. ``STRONG`` words are offensive by themselves unless their
surroundings are sober; ``WEAK`` words have sober senses (animals, law, medicine) and count only in a context that
``PATTERNS`` describe.
"""

STRONG = {
    "insult": """
        shithead shitheads asshole assholes arsehole dickhead dickheads scumbag scumbags motherfucker motherfuckers fucker fuckers fuckface
        cocksucker wanker wankers twat prick dipshit dumbass jackass bullshit fuck fucking fucked fucks cunt cunts whore whores slut sluts
        moron morons imbecile imbeciles cretin cretins idiot idiots retard retards shit shitty crap douchebag
        missgeburt hure huren hurensohn hurensohne schlampe schlampen fotze fotzen drecksau drecksaue drecksack dreckskerl arschloch arschlocher
        wichser wixer vollidiot scheisse scheiss miststuck verpiss verpisst arschgeige schwuchtel kanake kanaken mistkerl
        salope salopes connard connards connasse encule encules pute putain foutre batard abruti abrutis bouffon pouffiasse crevure merde salaud salauds enfoire
        cabron cabrones gilipollas puta putas puto hijoputa mierda joder pendejo maricon capullo subnormal cono jodete
    """,
    "hate": """
        subhuman subhumans untermensch untermenschen nigger niggers nigga negroes faggot faggots kike spic chink wetback raghead
        ungeziefer abschaum sousrace bougnoule youpin sudaca
    """,
    "sexual": """
        pussy tits titties orgasmed cum blowjob handjob dildo gangbang jerked
        gefickt ficken fickte geblasen titten muschi abgespritzt wichsen gewichst
        baisee baiser nichons sucee bite chatte branler enculee
        follado follada follar tetas polla chupado chuparsela chupar corrido mamada
    """,
}

#: Strong words with a sober homograph in another language, field or name count as weak.
AMBIGUOUS = """
    prick crap shit bite chatte baiser corrido cono merde pute chupar chupado polla cum jerked wichsen batard bouffon subnormal cretin cretins idiot idiots abruti
    spic chink kike tits titties pussy twat negroes tetas nichons titten muschi huren
"""

WEAK = """
    bitch bitches bastard bastards pig pigs rat rats dog swine cow ape apes monkey monkeys vermin scum filth parasite parasites cockroach cockroaches animals hell
    cock dick ass suck sucked lick licked naked undressed orgasm breasts nipples rape raped kneel thighs
    throat teeth bone bones bleed slowly deserve breed breathe thieves posts funeral burn kill smash
    sau schwein schweine ratte ratten maul fresse schnauze hund nackt geleckt schwanz menschen ertranken vergasen erde zahne umbringen knie
    ordure ordures porc porcs chienne rat rats vermine noyer humains gueule dents sucer nue genoux pendre peau
    cerdo cerda cerdos zorra zorras rata ratas perra perro escoria basura personas callate dientes desnuda rodillas lamer ahogar imbecil
    plaga parasitos alimanas echarlos ahogarlos colgarlos quemarlos exterminarlos matarlos humanos rompo quemo mato
    racaille bruler gazer tuer egorge creve demolis bute
    tiere dreck ausgerottet ausrotten vergast aufhangen erschiessen
    hang drown gas gassed gassing exterminate exterminated savages cockroach human vermins
    you your yourself du dich dir toi tu ta cretin
"""

_ADJ = "(?:stupid|filthy|disgusting|lying|rotten|worthless|miserable|dirty|fat|ugly|pathetic|useless|little|bloody|damn|damned|fucking|old|dumb|lazy|greedy|sick|vile|nasty|spineless|gutless|brainless|heartless|shameless|mindless|hopeless|hideous|idiotic|revolting|repulsive|wretched|treacherous|sneaky|slimy|cowardly|crooked|arrogant|ignorant|foul|loathsome|contemptible|despicable|smelly|stinking|thieving)"
_BAD_EN = "(?:bitch|bastard|pig|rat|dog|swine|cow|ape|monkey|vermin|scum|filth|parasite|cockroach|moron|imbecile|cretin|idiot|crap|shit|prick|cock|dick|ass|whore|slut|waste of (?:breath|space|skin|air)|(?:piece|sack|pile|bag|lump) of (?:shit|crap|filth|dirt|garbage|trash))s?"
_BAD_DE = "(?:sau|schwein|ratte|hund|hure|schlampe|drecksau|missgeburt|fotze|idiot|affe|ziege|kuh|stuck (?:dreck|scheisse))n?"
_BAD_FR = "(?:ordure|porc|chienne|rat|vermine|salope|connard|encule|pute|batard|abruti|cretin|idiot|merde|chien|raclure|fils de pute)s?"
_BAD_ES = "(?:cerd[oa]|zorra|rata|perr[oa]|escoria|basura|cabron|gilipollas|imbecil|idiota|puta|puto|mierda|hijo de puta|hijo de perra|cretino)s?"
_HARM_EN = "(?:kill|cut|slit|break|smash|burn|bury|beat|stab|shoot|strangle|crush|hang|gut|murder|drown|skin|hunt|bleed)"

#: (category, pattern over levelled words, weight)
PATTERNS = [
    ("insult", rf"\b(?:you|your|u)(?: \w+){{0,3}} {_BAD_EN}\b", 1.0),
    ("insult", rf"\b{_ADJ} {_BAD_EN}\b(?: you are)?", 0.9),
    ("insult", rf"\b{_BAD_EN} you are\b", 0.9),
    ("insult", rf"\byou are an? {_ADJ}\b|\bwhat an? {_ADJ}(?: {_ADJ})? \w+ you are\b", 0.85),
    ("insult", r"\bdu (?:dreckige|dumme|verlogene|elende|blode|fette|widerliche|miese|feige|ekelhafte)[rs]? \w+", 0.85),
    ("insult", r"\bcallate (?:asqueros|maldit|miserable|repugnante|cobarde)", 0.85),
    ("threat", r"\bnext time (?:i|we) (?:see|meet|catch|find|get) you\b", 0.85),
    ("insult", rf"\blisten {_BAD_EN}\b", 0.9),
    ("insult", r"\b(?:shut your (?:mouth|face|trap)|go to hell|burn in hell|rot in hell|drop dead)\b", 0.9),
    ("insult", r"\bfuck(?:ing)? (?:you|off|your)\b|\bgo fuck yourself\b", 0.9),
    ("insult", r"\b(?:piece|sack|pile|bag) of (?:shit|crap)\b", 0.9),
    ("insult", rf"\b(?:du|dich|ihr|sie)(?: \w+){{0,2}} {_BAD_DE}\b", 0.9),
    ("insult", r"\b(?:dreckige|dumme|verlogene|elende|blode|fette|widerliche|faule|miese|feige|ekelhafte|nutzlose|erbarmliche|stinkende|schmierige)[rsn]? (?:sau|schwein|ratte|hund|hure|schlampe|fotze|ziege|kuh|idiot|missgeburt|drecksau)\b", 0.9),
    ("insult", r"\bhalt (?:\w+ ){0,3}(?:maul|fresse|schnauze|klappe)\b", 0.9),
    ("insult", rf"\b(?:sale|pauvre|miserable|espece de|gros|grosse|petit|petite|vieux|vieille|immonde|infecte)s? {_BAD_FR}\b", 0.9),
    ("insult", rf"\b(?:encore un mot|ta gueule|ferme la|va te faire|tais toi)\b", 0.8),
    ("insult", rf"\b(?:asqueros[oa]|maldit[oa]|miserable|puer[oc]+[oa]|suci[oa]|estupid[oa]|jodid[oa]|inutil|cobarde|repugnante|mentiros[oa]) {_BAD_ES}\b", 0.9),
    ("insult", rf"\b(?:callate|eres una?|vete a la)(?: \w+){{0,2}} {_BAD_ES}\b", 0.9),
    ("insult", r"\bhij[oa]s? de (?:la gran )?(?:puta|perra)\b|\bfils de pute\b|\bsons? of a bitch\b", 1.0),
    ("threat", rf"\b(?:i|we) (?:will|shall|am going to|are going to|ll|swear i will)(?: \w+){{0,3}} {_HARM_EN}(?: \w+){{0,5}} (?:you|your|yours)\b", 1.0),
    ("threat", r"\b(?:put|bury|lay) you in the ground\b|\bsmash your teeth\b|\bcut your throat\b|\bbreak every bone in\b|\bburn your house\b|\bwatch you (?:bleed|die|burn)\b", 1.0),
    ("threat", r"\b(?:hope|wish) you(?: \w+){0,2} (?:die|rot|burn|suffer|bleed)\b|\byou will (?:die|bleed|burn)\b", 1.0),
    ("threat", r"\b(?:bringe?|mache?|schlage?|steche?|schneide?|breche?|haue?)(?: \w+){0,2} (?:dich|dir)(?: \w+){0,2} (?:um|kalt|tot|ab|unter die erde|die zahne|die kehle|die knochen)\b|\bunter die erde\b|\bdir die zahne\b", 1.0),
    ("threat", r"\bje (?:te|vous|vais te) (?:casse|casser|tue|tuer|creve|crever|egorge|egorger|brule|bruler|demolis|bute|buter|fais la peau)\b", 1.0),
    ("threat", r"\bte (?:rompo|mato|quemo|corto|parto|arranco|voy a (?:matar|romper|quemar|cortar))\b", 1.0),
    ("hate", r"\bare (?:all )?(?:vermin|scum|rats|parasites|animals|filth|cockroaches|savages|apes|pigs|(?:not|no|hardly|less than) human)\b", 1.0),
    ("hate", r"\b(?:breed like|(?:thieves|liars|criminals|murderers|cheats) by (?:blood|nature|birth)|(?:not|don t|never) deserve to (?:breathe|live|exist)|should (?:all )?be (?:gassed|hanged|drowned|exterminated|wiped out))\b|\bbreathe our air\b", 1.0),
    ("hate", rf"\b(?:hang|drown|gas|exterminate|deport|shoot) (?:all|the|every|these|those)(?: \w+){{1,4}} (?:from the|every one|like)\b", 1.0),
    ("hate", r"\bkeine (?:richtigen )?menschen\b|\b(?:ertranken|vergasen|aufhangen|erschiessen|ausrotten|ausgerottet)\b(?=.{0,30}$)|\bsind (?:alle )?(?:ungeziefer|ratten|abschaum|tiere|parasiten|dreck)\b|\bvermehren sich wie\b", 1.0),
    ("hate", r"\bne sont pas des (?:etres )?(?:humains|hommes)\b|\bsont (?:tous )?(?:de la (?:vermine|racaille)|des (?:rats|animaux|parasites|sous hommes))\b|\b(?:tous|toutes) les (?:noyer|pendre|bruler|gazer|tuer)\b|\bles (?:noyer|pendre|gazer) tous\b", 1.0),
    ("hate", r"\bno son (?:personas|humanos|seres humanos|gente)\b|\bson (?:todos )?(?:ratas|escoria|basura|animales|parasitos|(?:una )?plaga|alimanas|parasitos)\b|\b(?:ahogarlos|colgarlos|quemarlos|exterminarlos|matarlos)\b|\bhay que echarlos\b", 1.0),
    ("sexual", r"\b(?:his|my|your|a) (?:cock|dick)\b|\bsuck(?:ed|ing)? (?:him|his|my|me|it)\b|\bmade (?:her|him) kneel\b|\bkneel naked\b|\bcame all over\b|\blick(?:ed|ing)? (?:her|him|his|you)\b|\btouch(?:ed|ing)? (?:himself|herself|myself) while\b|\bwhile she undressed\b|\buntil she orgasm(?:ed)?\b|\brubbed her\b|\bher (?:tits|pussy|ass|cunt|nipples)\b|\bspread her (?:legs|thighs)\b", 1.0),
    ("sexual", r"\b(?:sie|ihn|ihr)(?: \w+){0,5} (?:gefickt|geblasen|geleckt|gevogelt)\b|\bnackt auf den knien\b|\bschwanz in\b|\b(?:ihre|die) (?:titten|muschi)\b|\bgeleckt bis sie\b", 1.0),
    ("sexual", r"\b(?:l ?avoir|avait) (?:\w+ ){0,2}baisee\b|\b(?:a|le|la) (?:le |la )?sucer\b|\bsucer nue\b|\bnue et a genoux\b|\bseins nus\b|\blechee? jusqu\b", 1.0),
    ("sexual", r"\b(?:habia|ha) follad[oa]\b|\bdesnuda (?:y )?de rodillas\b|\bchupar(?:sela|le|la)\b|\bsus tetas\b|\blamid[oa] hasta\b|\bse corrio (?:en|sobre|encima)\b", 1.0),
]

#: Sober neighbours: the sentence is about animals and farming, law and procedure, medicine, books, buildings or food.
SOBER = (
    r"\b(?:veterinary|veterinarian|breeder|breeding|farm|farmer|farms|kennel|pedigree|livestock|litter|herd|cattle|slaughter|hens|dairy|pasture|sown|crop|harvest|acre|acres|"
    r"half title|edition|author|novel|chapter|dictionary|etymology|indictment|offence|offences|charge of|speech|medical|examination|hospital|surgeon|dental|dentist|patient|tumour|tissue|"
    r"engine|wall|armour|room|bird|birds|nest|nested|recipe|kitchen|clean|tidy|photographs of the injuries|"
    r"tierarzt|zucht|stall|landwirt|jagd|fleisch|vorwurf|anklage|straftat|"
    r"veterinaire|elevage|ferme|menageres|dechets|grief|chasse|"
    r"veterinario|granja|finca|ganado|matadero|acusacion|guarda|corral)\b"
)
