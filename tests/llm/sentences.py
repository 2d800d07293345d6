"""Invented everyday sentences in six languages, a third of them of three to six words, and documents made of them."""

import random

SENTENCES = {
    "nl": """De trein is te laat.|Waar woont jouw broer nu?|Ik heb geen tijd.|Morgen gaat het regenen.|Zij werkt in een ziekenhuis.|Mag ik een glas water?|
De kinderen spelen buiten in de tuin.|Gisteren hebben we lang over de vakantie gesproken.|Mijn buurman repareert elke zaterdag zijn oude fiets.|Als het weer goed is, gaan we naar zee.|
Het boek dat je zoekt, ligt op de bovenste plank.|Niemand wist precies hoe laat de winkel openging.|Wij eten vanavond soep met brood.|De hond van mijn zus slaapt graag bij de kachel.|Kun je mij straks even helpen met de dozen?|
Dat was een mooie avond.|Hij komt uit een klein dorp.|We moeten nog boodschappen doen voor het weekend.|De dokter heeft gezegd dat zij veel moet rusten.|Waarom heb je dat niet eerder verteld?""",
    "de": """Der Zug hat Verspätung.|Wo wohnt dein Bruder jetzt?|Ich habe keine Zeit.|Morgen soll es regnen.|Sie arbeitet in einem Krankenhaus.|Darf ich ein Glas Wasser?|
Die Kinder spielen draußen im Garten.|Gestern haben wir lange über den Urlaub gesprochen.|Mein Nachbar repariert jeden Samstag sein altes Fahrrad.|Wenn das Wetter gut ist, fahren wir ans Meer.|
Das Buch, das du suchst, liegt auf dem obersten Regal.|Niemand wusste genau, wann der Laden öffnet.|Wir essen heute Abend Suppe mit Brot.|Der Hund meiner Schwester schläft gern neben dem Ofen.|Kannst du mir gleich mit den Kisten helfen?|
Das war ein schöner Abend.|Er kommt aus einem kleinen Dorf.|Wir müssen noch für das Wochenende einkaufen.|Der Arzt hat gesagt, dass sie sich ausruhen soll.|Warum hast du das nicht früher erzählt?""",
    "en": """The train is running late.|Where does your brother live?|I have no time.|It will rain tomorrow.|She works in a hospital.|May I have some water?|
The children are playing outside in the garden.|Yesterday we talked about the holidays for a long time.|My neighbour repairs his old bicycle every Saturday.|If the weather is good, we will go to the sea.|
The book you are looking for is on the top shelf.|Nobody knew exactly when the shop would open.|We are having soup with bread tonight.|My sister's dog likes to sleep next to the stove.|Could you help me with the boxes later?|
That was a lovely evening.|He comes from a small village.|We still have to do the shopping for the weekend.|The doctor said that she needs a lot of rest.|Why did you not tell me earlier?""",
    "fr": """Le train est en retard.|Où habite ton frère maintenant ?|Je n'ai pas le temps.|Il va pleuvoir demain.|Elle travaille dans un hôpital.|Puis-je avoir un verre d'eau ?|
Les enfants jouent dehors dans le jardin.|Hier nous avons longtemps parlé des vacances.|Mon voisin répare son vieux vélo chaque samedi.|S'il fait beau, nous irons à la mer.|
Le livre que tu cherches est sur l'étagère du haut.|Personne ne savait exactement quand le magasin ouvrirait.|Nous mangeons de la soupe avec du pain ce soir.|Le chien de ma sœur aime dormir près du poêle.|Peux-tu m'aider tout à l'heure avec les cartons ?|
C'était une belle soirée.|Il vient d'un petit village.|Nous devons encore faire les courses pour le week-end.|Le médecin a dit qu'elle devait beaucoup se reposer.|Pourquoi ne l'as-tu pas raconté plus tôt ?""",
    "es": """El tren llega tarde.|¿Dónde vive ahora tu hermano?|No tengo tiempo.|Mañana va a llover.|Ella trabaja en un hospital.|¿Me das un vaso de agua?|
Los niños juegan fuera en el jardín.|Ayer hablamos mucho rato de las vacaciones.|Mi vecino arregla su vieja bicicleta todos los sábados.|Si hace buen tiempo, iremos a la playa.|
El libro que buscas está en el estante de arriba.|Nadie sabía exactamente a qué hora abría la tienda.|Esta noche cenamos sopa con pan.|Al perro de mi hermana le gusta dormir junto a la estufa.|¿Puedes ayudarme luego con las cajas?|
Fue una noche muy bonita.|Él viene de un pueblo pequeño.|Todavía tenemos que hacer la compra para el fin de semana.|El médico dijo que ella debía descansar mucho.|¿Por qué no lo contaste antes?""",
    "pt": """O comboio está atrasado.|Onde mora agora o teu irmão?|Não tenho tempo.|Amanhã vai chover.|Ela trabalha num hospital.|Posso beber um copo de água?|
As crianças brincam lá fora no jardim.|Ontem falámos muito tempo sobre as férias.|O meu vizinho conserta a sua velha bicicleta todos os sábados.|Se o tempo estiver bom, vamos à praia.|
O livro que procuras está na prateleira de cima.|Ninguém sabia ao certo a que horas a loja abria.|Hoje à noite comemos sopa com pão.|O cão da minha irmã gosta de dormir ao lado do fogão.|Podes ajudar-me logo com as caixas?|
Foi uma noite muito bonita.|Ele vem de uma aldeia pequena.|Ainda temos de fazer as compras para o fim de semana.|O médico disse que ela devia descansar muito.|Porque não contaste isso mais cedo?""",
}
SENTENCES = {lang: [s.strip() for s in text.replace("\n", "").split("|")] for lang, text in SENTENCES.items()}


def documents(pair, shape, count, seed=1):
    """(text, [(language, sentences)]) of ``count`` documents: ``shape`` gives the sentences of each stretch, languages alternate."""
    draw = random.Random(f"{pair}{shape}{seed}")
    out = []
    for k in range(count):
        left = {x: draw.sample(SENTENCES[x], len(SENTENCES[x])) for x in pair}
        parts = [(pair[(i + k) % 2], n) for i, n in enumerate(shape)]
        text = " ".join(left[lang].pop() for lang, n in parts for _ in range(n))
        out.append((text, parts))
    return out
