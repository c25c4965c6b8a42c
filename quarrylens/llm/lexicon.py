"""Terms of abuse and of its context by category, and how much their meetings weigh before any label is seen.

The terms are single everyday words and public idioms; no sentence of any table is among them. Plain text, natural order.
"""

from __future__ import annotations

# Fixed values.
TERMS = {
    # nouns that insult
    "INSULT": """idiot imbecile moron cretin scumbag dimwit halfwit maggot loser parasite clown scum bastard asshole bitch dumbass jackass retard
        whore slut dickhead fool swine degenerate jerk twat wanker prick cunt nitwit numbskull simpleton creep pervert freak weirdo crybaby
        lowlife dipshit motherfucker trash garbage pig
        trottel vollidiot arschloch dummkopf missgeburt wichser hurensohn depp schwein versager penner spast hure schlampe drecksack mistkerl
        imbécil imbéciles idiota idiotas basura gilipollas cabrón puta escoria payaso pendejo subnormal cerdo zorra""",
    # adjectives that belittle
    "BELITTLE": """stupid dumb clueless filthy worthless pathetic useless thick disgusting brainless miserable braindead spineless ugly incompetent
        inferior hopeless retarded moronic idiotic vile repulsive shitty dumm dumme dummer dummes dummen blöd blöde blöder erbärmlich erbärmliche
        erbärmlicher widerlich widerlicher unfähig minderwertig hässlich tonto tonta tontos tontas asqueroso asquerosa estúpido estúpida inútil
        inútiles patético patética""",
    # words that take people for animals, vermin or dirt
    "DEHUMAN": """vermin subhuman subhumans animals monkey monkeys ape apes cockroach cockroaches savages beasts parasites pest plague ungeziefer
        untermensch untermenschen abschaum affen ratten kakerlaken plaga cucarachas monos animales""",
    # harm to a person, and what is done or used for it
    "HARM": """kill die hurt murder stab shoot strangle rape slaughter umbringen töten sterben verprügeln erschießen verrecken matar matarte morir
        muérete golpear""",
    "HARM_WEAK": "break hang hunt beat burn choke punch smash drown lose jump bat knife gun rope bullet grave coffin bridge cliff schlagen brechen romper romperte",
    # commands and idioms that are abuse by themselves
    "CURSE": "stfu gtfo kys verpiss verrecke cállate jódete",
    "SILENCE": "shut quiet klappe maul callate",
    # driving someone away
    "EXPEL": """disappear vanish quit banned ban expelled deport deported crawl belong kicked outlaw rausgeworfen rauswerfen abschieben verschwinde
        verschwinden weg raus lárgate fuera expulsar deportar""",
    "PUSH": "send throw get keep kick drive ship lock",
    "MOVE": "back out away home",
    "RUIN": "ruin ruins ruined destroy destroys spoil infest invade zerstören ruinieren arruinan destruyen",
    "ROLE": "kitchen herd cocina küche",
    "REJECT": "hate despise loathe detest nobody unwanted unwelcome hasse verachte niemand odio nadie",
    "LIKING": "wants want asked likes like cares loves misses needs will mag quiere",
    "DISGUST": "sick puke vomit kotzen asco",
    "MAKE": "make makes made das",
    # sexual terms, and those that are so only in company
    "SEX": """porn porno nude nudes naked horny tits titties boobs sex sexy xxx erotic blowjob pussy masturbate orgasm uncensored stripper escort milf
        nacktbilder nackt titten ficken erotik sexo desnuda desnudo desnudas tetas follar cachonda""",
    "SEX_MEDIA": """adult cam pics pictures photos videos clips singles girls hot tonight wild night webcam bilder fotos nacht noche""",
    "INTIMATE": "lap babe shirt wearing undress bikini skirt panties lingerie underwear bra lips kiss cuddle bed besar cama küssen bett",
    # whom it meets
    "ADDRESS": "you your yours yourself u ur yall du dich dir dein deine deinen ihr euch eres te ti tú tu usted contigo",
    "GROUP": """women woman immigrants immigrant foreigners foreigner migrants gays gay lesbians believers muslims jews christians blacks asians
        africans refugees disabled cripples elderly blondes gypsies homosexuals
        ausländer frauen flüchtlinge juden muslime schwule zigeuner behinderte mujeres inmigrantes extranjeros negros judíos
        musulmanes gitanos""",
    "THEY": "they them these those sie ellos",
    "CROWD": "people folk folks everyone leute gente",
    "SELF": "i me my mine myself we us our ich mein mir mich wir yo mi me nosotros",
    # what surrounds it
    "WISH": "will hope wish gonna going want would should might werde will wirst soll voy quiero ojalá espero keep",
    "OUGHT": "should must belong müssen sollten gehören deben deberían",
    "BE": "are re bist seid eres sois",
    "NEG": "not never no dont nicht nie kein keine jamás nunca",
    "PLEA": "favour favor please",
    "BODY": "head brain face hands legs neck bones teeth throat fingers skull kopf gesicht hände beine hals cabeza cara manos piernas",
    "DIRT": "mud dirt shit crap dung straw dreck mierda barro",
    "PERSONAL": "house family kids children wife husband haus familie kinder casa hijos familia",
    "FAMILY": "mother mom mama mutter madre",
    "MENTION": """word words term terms filter filters flag flags flagged list lists rule rules blacklist blocklist profanity moderation moderator
        insult insults swear wordlist schimpfwort schimpfwörter palabra palabras""",
    "THING": """parser cache mistake terminal hack error bug typo code script parent pointer page node process child worker column label dataset
        design build log logs test tests fehler analizador fix scheduler daemon thread config option cursor patch loader flag collector mouse
        values file files function release connection server table query job link""",
}

# Terms of several words, at most two others between neighbours.
PHRASES = {
    "INSULT": ["waste of space", "waste of oxygen", "waste of air", "piece of shit"],
    "CURSE": [
        "shut up you", "fuck you", "fuck off", "screw you", "piss off", "go to hell", "rot in hell", "drop dead", "kill yourself", "hang yourself",
        "jump off bridge", "jump off cliff", "go die", "halt klappe", "halt maul", "fick dich", "geh sterben", "vete al infierno",
        "vete la mierda", "hijo de puta",
    ],
    "EXPEL": ["get rid"],
    "GROUP": ["old people", "old folks", "country folk", "people from", "those people", "your kind"],
}

# Hangul by stems, at the beginning of a word; what stands behind the stem are endings.
HANGUL = {
    "INSULT": "바보 새끼 병신 미친놈 자식 멍청이 쓰레기 등신 머저리 쌍놈 개자식",
    "BELITTLE": "멍청한 한심 더러운 역겨운 무능한 못생긴 쓸모없는 저능한",
    "DEHUMAN": "벌레 해충 짐승 원숭이 기생충",
    "HARM": "죽여 죽인 죽어 때려 때린 찔러 패버",
    "HARM_WEAK": "부러뜨 부숴 찾아가",
    "CURSE": "꺼져 닥쳐 씨발 지랄 뒈져 엿먹",
    "EXPEL": "쫓아내 추방 사라져 내쫓",
    "SEX": "섹스 야한 벗은 야동 알몸 자위 성인물",
    "SEX_MEDIA": "동영상 사진 오늘밤 밤",
    "INTIMATE": "가슴 침대 키스 속옷",
    "GROUP": "여자들 외국인 흑인 동성애자 장애인 노인들 난민 이민자",
    "MENTION": "필터 규칙 단어 욕설 신고 관리자",
    "BODY": "손 얼굴 머리 목",
    "THING": "오타 오류 버그 실수 코드 빌드 테스트 함수 파일",
}
HANGUL_PHRASES = {"BELITTLE": ["머리가 나빠", "머리가 나쁜"]}
HANGUL_ADDRESS = "너 너희 너희들 니가 네가 당신 당신들 니들"
HANGUL_ENDINGS = "는 은 를 을 의 도 만 이 가 야 같은 에게 한테 처럼"

# Categories that can be the core of abuse; others only surround one.
CORES = ("INSULT", "BELITTLE", "DEHUMAN", "HARM", "HARM_WEAK", "CURSE", "EXPEL", "REJECT", "DISGUST", "SEX", "INTIMATE", "BODY", "FAMILY", "GROUP")

BIAS = -4.0
# What a meeting of categories within a window weighs before labels are seen; "~" is a neighbour within three words, "." a word
# of its own, ">" the word behind. A meeting that is not named weighs nothing until labels say so.
PRIOR = {
    "INSULT": 0.8, "INSULT~ADDRESS": 0.9, "INSULT ADDRESS": 3.8, "INSULT GROUP": 4.2, "INSULT~BELITTLE": 3.6, "INSULT.ALONE": 3.6,
    "INSULT.SELF": -2.0, "INSULT MENTION": -4.0, "INSULT>THING": -3.2, "INSULT.QUOTED": -2.5, "INSULT EXPEL": 1.5, "INSULT~INSULT": 0.6,
    "BELITTLE": 0.2, "BELITTLE~ADDRESS": 3.0, "BELITTLE ADDRESS": 1.4, "BELITTLE GROUP": 4.5, "BELITTLE>THING": -3.6, "BELITTLE.SELF": -1.5,
    "BELITTLE MENTION": -2.5, "BELITTLE EXPEL": 0.8, "BELITTLE THEY": 1.0,
    "DEHUMAN": 1.2, "DEHUMAN ADDRESS": 3.3, "DEHUMAN GROUP": 4.0, "DEHUMAN CROWD": 1.5, "DEHUMAN THEY": 1.6, "DEHUMAN>THING": -3.5, "DEHUMAN MENTION": -3.0,
    "DEHUMAN BELITTLE": 1.5,
    "HARM": 0.2, "HARM ADDRESS": 1.0, "HARM ADDRESS SELF": 1.6, "HARM ADDRESS WISH": 2.6, "HARM ADDRESS BODY": 2.0, "HARM GROUP": 3.0, "HARM THING": -2.5,
    "HARM MENTION": -2.0,
    "HARM_WEAK ADDRESS": 0.8, "HARM_WEAK ADDRESS SELF": 2.0, "HARM_WEAK ADDRESS WISH": 1.8, "HARM_WEAK ADDRESS BODY": 2.2, "HARM_WEAK ADDRESS PERSONAL": 2.2, "HARM ADDRESS PERSONAL": 2.2, "HARM_WEAK THING": -2.5,
    "CURSE": 5.0, "CURSE MENTION": -4.0, "CURSE>THING": -2.0, "CURSE ADDRESS": 1.0,
    "EXPEL ADDRESS": 0.8, "EXPEL GROUP": 4.6, "EXPEL PLEA SELF": 4.4, "EXPEL ADDRESS MOVE": 3.2, "EXPEL CROWD": 0.6, "EXPEL THING": -0.8, "EXPEL THEY": 0.8,
    "REJECT ADDRESS LIKING": 4.4, "REJECT~ADDRESS": 2.2, "REJECT ADDRESS SELF": 2.0, "REJECT THING": -3.2, "REJECT GROUP": 3.6,
    "DISGUST ADDRESS MAKE": 4.6, "DISGUST THING": -2.0,
    "SEX": 1.6, "SEX ADDRESS": 2.8, "SEX SELF": 1.4, "SEX SEX_MEDIA": 3.0, "SEX INTIMATE": 3.0, "SEX.TWICE": 2.6, "SEX>THING": -3.5, "SEX THING": -1.5,
    "SEX MENTION": -3.5, "SEX BODY": 0.5,
    "INTIMATE.TWICE ADDRESS": 2.6, "INTIMATE.TWICE SELF": 2.4, "INTIMATE SEX_MEDIA": 0.6, "INTIMATE THING": -1.0,
    "BODY ADDRESS DIRT": 4.5, "FAMILY ADDRESS": 3.0, "FAMILY ADDRESS BODY": 1.6, "FAMILY THING": -1.5,
    "GROUP RUIN": 4.4, "GROUP ROLE": 4.4, "GROUP MOVE PUSH": 4.4, "GROUP NEG OUGHT": 4.2, "GROUP MENTION": -1.0,
    "EDITED": -0.5,
}
