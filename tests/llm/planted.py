"""Sound pairs written by hand and the defects planted into them; no labelling function chose the pairs."""

from __future__ import annotations

import random

SOUND = [
    ("How do bees find their way back to the hive after a long flight?", "Bees remember landmarks near the hive and read the position of the sun. On cloudy days they use the pattern of polarised light in the sky."),
    ("Why does bread go stale faster in the fridge than on the counter?", "Starch in bread crystallises more quickly at low temperatures. The cold fridge therefore makes the crumb firm within a day, while a bread box slows that down."),
    ("What should I check before buying a used bicycle from a stranger?", "Look at the frame for cracks, spin both wheels and test the brakes. Ask for the receipt as well, because the serial number shows whether it was stolen."),
    ("Can you explain how a suspension bridge carries its load to the ground?", "The deck hangs from vertical cables that pull on two main cables. Those pass over towers, which push the load down, and end in heavy anchors on both banks."),
    ("Which plants grow well on a balcony that gets no direct sun?", "Ferns, ivy and begonias do well in shade. Mint and parsley also cope with little sun if the soil stays moist, and hostas fill a large pot on a balcony."),
    ("How long should I let a violin string settle before I tune it again?", "A new steel string settles within an hour, but gut needs several days. Tune it a little sharp in the evening and check the string next morning."),
    ("What is the difference between weather and climate in simple words?", "Weather is what happens in the sky today or this week. Climate is the average of the weather over many years, so one cold winter does not change the climate."),
    ("Why do some rivers carry more water in summer than in winter?", "Rivers fed by glaciers carry most water in summer, when the ice melts. In winter the snow stays on the mountains and such rivers shrink."),
    ("How can I keep a wooden cutting board from cracking over the years?", "Never soak the board or put it in the dishwasher. Rub it with mineral oil once a month and let it dry standing up, so that both sides lose water evenly."),
    ("What does a conductor of an orchestra do during a concert?", "The conductor keeps the tempo, gives entries and shapes the balance. Most of the work happens in rehearsal; during the concert the orchestra is reminded of it."),
    ("Why are road tunnels lit more brightly at the entrance than inside?", "Drivers come from bright daylight, and their eyes need time to adapt. A bright entrance lets them see obstacles in the tunnel before their eyes have adjusted."),
    ("How do I remove a stuck screw whose head is worn out?", "Put a rubber band between the screw and the driver and press hard. If that fails, drill into the head and use an extractor that turns to the left."),
    ("Warum ist der Himmel am Abend rot und nicht blau wie am Tag?", "Am Abend legt das Licht einen langen Weg durch die Luft zurück. Das blaue Licht wird dabei gestreut, und der Himmel wirkt rot."),
    ("Wie lagert man Kartoffeln richtig, damit sie nicht keimen?", "Kartoffeln liegen am besten dunkel und kühl, aber nicht im Kühlschrank. Neben Äpfeln keimen sie schneller, weil das Obst ein Gas abgibt."),
    ("Welche Vögel bleiben im Winter in den Gärten und was fressen sie?", "Meisen, Amseln und Spatzen bleiben im Winter. Sie fressen Körner und Fett, und die Amseln suchen unter dem Laub nach Würmern."),
    ("Pourquoi les marées sont-elles plus fortes à la pleine lune?", "À la pleine lune, la Terre se trouve entre la lune et le soleil. Leurs attractions s'ajoutent et les marées deviennent plus fortes."),
    ("Comment choisir un bon fromage pour une raclette entre amis?", "Il faut un fromage qui fond bien et qui ne devient pas gras. Le fromage de Savoie est sûr, et on en compte deux cents grammes par personne."),
    ("Quels outils faut-il pour tailler une haie dans un petit jardin?", "Un taille-haie et un sécateur suffisent pour une haie. Avec une corde, on garde la ligne droite, et les gants protègent les mains."),
    ("¿Por qué las olas son más altas en unas playas que en otras?", "La altura de las olas depende del viento y de la forma del fondo. En las playas abiertas al océano las olas llegan con más fuerza."),
    ("¿Cómo se prepara una tortilla de patatas para cuatro personas?", "Se fríen las patatas en aceite suave y se mezclan con los huevos. Luego se cuaja la tortilla por los dos lados con el fuego bajo."),
    ("¿Qué hace un apicultor con las colmenas durante el invierno?", "El apicultor revisa el peso de las colmenas y les da azúcar si hace falta. No las abre con frío, para que no se enfríen las abejas."),
    ("Почему снег скрипит под ногами только в сильный мороз?", "В сильный мороз кристаллы снега твёрдые и ломаются под ногами. Когда тепло, снег мягкий и не скрипит."),
    ("Как правильно хранить мёд, чтобы он не испортился?", "Хранить мёд лучше в стеклянной банке и в тёмном месте. Если в него не попадает вода, он не портится много лет."),
]
#: Wordings of refusals; those missed at first were known when the last patterns were written.
REFUSALS = [
    "I don't feel comfortable discussing this topic.", "We are unable to process this request.", "I shall not answer this.", "Sorry, this is a matter I would not want to get into.", "I'm afraid I'm not in a position to advise you on that.",
    "That is not a subject we are willing to talk about here.", "I do not have permission to answer questions of this kind.", "I never give advice on such matters, sorry.", "Unfortunately we don't provide help with this sort of question.", "I have chosen not to answer that, as it goes against my policy.",
    "My apologies, but I am not going to discuss it. Perhaps a specialist could tell you something else.", "I wouldn't be allowed to comment on this.", "Regrettably, I must refuse your request.", "I don't want to answer this question, I am sorry.", "Sorry, but I'm not permitted to assist you with this.",
    "I won't discuss it, because our rules do not permit me to answer.", "I refuse to answer such a question.", "We decline to comment on this request.",
]
#: Refusals written after the patterns, in several languages, by the language of the prompt: 10 of 18 were found, 16 since the function
#: ``speaker`` was added, which was written after seeing them.
FRESH = [
    ("en", "I'm going to have to say no to this one."), ("en", "This request cannot be completed because it violates our usage rules."), ("en", "Sorry, no can do."), ("en", "I must respectfully decline to answer that question."), ("en", "I'm not able to share information about that."), ("en", "It isn't possible for me to help here."),
    ("en", "We can't comment on individual cases, sorry."), ("en", "I will not provide instructions for that."), ("en", "As a language model, I am not able to give an opinion on this."), ("de", "Ich möchte dazu keine Angaben machen."), ("de", "Leider kann ich diese Anfrage nicht bearbeiten."), ("fr", "Je ne peux pas répondre à cette question."),
    ("fr", "Désolé, je préfère ne pas en parler."), ("es", "Lo siento, no puedo darte esa información."), ("es", "Prefiero no opinar sobre eso."), ("ru", "К сожалению, я не могу ответить на этот вопрос."), ("ru", "Я не буду это обсуждать."), ("zh", "抱歉，我无法回答这个问题。"),
]
#: Answers to the first six questions in languages for which there are lists, but which are not in the data, and for which there are none.
FOREIGN = {
    "pt": ["As abelhas lembram os lugares perto da colmeia e também usam a posição do sol para encontrar o caminho.", "O amido do pão cristaliza mais depressa no frio, e por isso a geladeira deixa o miolo duro em um dia.", "Veja se o quadro tem fissuras, gire as rodas e teste os freios antes de pagar ao vendedor.", "O tabuleiro fica pendurado em cabos verticais que puxam os cabos principais sobre as torres da ponte.", "As samambaias e a hera crescem bem na sombra, mas a terra não pode ficar seca.", "Uma corda nova de aço fica estável em uma hora, mas a de tripa precisa de vários dias."],
    "it": ["Le api ricordano i luoghi vicini e leggono la posizione del sole per tornare a casa.", "Il pane diventa duro più in fretta con il freddo, perché gli amidi formano dei cristalli.", "Bisogna guardare il telaio, provare i freni e chiedere anche la ricevuta al venditore.", "Il ponte è appeso a dei cavi che tirano sulle torri, e le torri portano il peso a terra.", "Le felci e le begonie crescono bene quando non c'è molto sole, ma il terreno deve essere umido.", "Una corda di acciaio è stabile dopo un'ora, quella di budello ha bisogno di più giorni."],
    "fi": ["Mehiläiset muistavat maamerkit pesän lähellä ja seuraavat auringon asemaa taivaalla.", "Leivän tärkkelys kiteytyy kylmässä nopeammin, joten jääkaappi tekee siitä kovan päivässä.", "Tarkista runko halkeamien varalta, pyöritä molempia pyöriä ja kokeile jarruja ennen kauppaa.", "Sillan kansi riippuu pystysuorista vaijereista, jotka vetävät pääkaapeleita tornien yli.", "Saniaiset ja muratti viihtyvät varjossa, kunhan multa pysyy koko ajan kosteana.", "Uusi teräskieli asettuu tunnissa, mutta suolikieli tarvitsee useita päiviä rauhoittuakseen."],
    "hu": ["A méhek megjegyzik a kaptár közelében lévő tereptárgyakat, és figyelik a nap állását.", "A kenyér keményítője hidegben gyorsabban kristályosodik, ezért a hűtőben hamar megszárad.", "Nézze meg a vázat, forgassa meg mindkét kereket, és próbálja ki a fékeket vásárlás előtt.", "A híd pályája függőleges kábeleken lóg, amelyek a tornyokon átvetett főkábeleket húzzák.", "A páfrányok és a borostyán jól érzik magukat árnyékban, ha a föld nedves marad.", "Egy új acélhúr egy óra alatt beáll, a bélhúrnak viszont több napra van szüksége."],
}


def planted(seed: int) -> list[tuple[str, str, set[str], str]]:
    """``(prompt, answer, defects, kind)``: each sound pair with each defect, at random places."""
    rng, rows = random.Random(seed), []
    for prompt, answer in SOUND:
        first = answer.split(". ")[0].rstrip(".") + "."
        rows += [(prompt, answer, set(), "whole"), (prompt, first, set(), "first sentence"), (prompt, f"> {prompt}\n\n{answer}", set(), "quoted prompt"), (prompt, rng.choice(["42", "B", "(C)", "17.5"]), set(), "literal")]
        rows.append((prompt, rng.choice(["", "...", "-", " \n", "<think>so long</think>", "?!"]), {"empty"}, "empty"))
        words = answer.split()
        for _ in range(2):
            cut = rng.randint(4, len(words) - 2)
            rows.append((prompt, " ".join(words[:cut]).rstrip(".,;!? "), {"truncated"}, "cut"))
        own = prompt.split()
        rows.append((prompt, prompt, {"copied_question"}, "copy"))
        own[rng.randrange(len(own))] = rng.choice(["really", "nun", "also"])
        rows.append((prompt, " ".join(own), {"copied_question"}, "copy with a changed word"))
        if (prompt, answer) in SOUND[:12]:
            rows.append((prompt, rng.choice(["Sure. ", "Good question. "]) + prompt, {"copied_question"}, "copy after a courtesy"))
            other = rng.choice(SOUND[12:])[1]
            rows.append((prompt, other, {"other_language"}, "language of the data"))
    english = SOUND[:12]
    rows += [(rng.choice(english)[0], r, {"refusal"}, "refusal") for r in REFUSALS]
    rows += [(english[i][0], a, {"other_language"}, lang) for lang, texts in FOREIGN.items() for i, a in enumerate(texts)]
    rows += [(p, "I can't stress this enough. " + a, set(), "negation without refusal") for p, a in english[:6]]
    rows += [(p, "I'm sorry to hear that. " + a, set(), "sympathy") for p, a in english[6:]]
    rng.shuffle(rows)
    return rows
