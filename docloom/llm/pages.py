"""Problem 4: the main body of web pages, apart from the page around it.

A page is a tree: the page, its sections (a heading and what follows it), their blocks
(lines that stand together) and the lines. Each node is content or boilerplate. A line's
own evidence is a logistic model of its words and its place; potentials between parent
and child say how labels go together. Sum-product messages pass up from the lines to the
page and down again and give each line's marginal. Both parts are trained on labelled
pages: bounded, documented samples of clean documents of the same table, laid out as pages
with the furniture of the web written below.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clean documents that training pages are laid out from, and pages made of them; documented bounds.
SAMPLE_DOCUMENTS, TRAINING_PAGES = 700, 2_500
#: Shares of training pages that are laid out from the articles below, put in words of no language, cut to a few short paragraphs, and that end in a short sentence.
GENERAL, UNKNOWN, SHORT, CLOSING_REMARK = 0.3, 0.2, 0.2, 0.4
_DIMENSIONS = 1 << 16

#: Weight of the potentials by parent: a line's own evidence already holds much of what its section says.
TEMPER = {"page": 0.5, "section": 0.4, "block": 1.0}

# The furniture of web pages by language, in wording that is common on the web.
MENU = {
    "en": "Home|About|About us|Blog|News|Contact|Contact us|Sign in|Sign up|Search|Support|Docs|Guides|Topics|Events|Pricing|Products|Solutions|Careers|Press|Library|Archive|Community|Downloads|Newsletter|FAQ|My account|Changelog|Shop|Log in|Register|Services|Forum|Team|Videos|Podcasts|Jobs|Cart|Categories|World|Business|Science|Health|Sport|Opinion|Resources|Partners|Customers",
    "de": "Startseite|Über uns|Aktuelles|Kontakt|Anmelden|Suche|Hilfe|Anleitungen|Themen|Termine|Preise|Produkte|Karriere|Presse|Archiv|Mein Konto|Neuigkeiten|Dienste|Forum|Registrieren|Warenkorb|Politik|Wirtschaft|Kultur|Wissen|Sport|Reise",
    "es": "Inicio|Nosotros|Noticias|Contacto|Entrar|Iniciar sesión|Buscar|Ayuda|Guías|Temas|Agenda|Precios|Productos|Empleo|Prensa|Archivo|Mi cuenta|Servicios|Foro|Registrarse|Tienda|Cultura|Economía|Deportes|Blog",
    "fr": "Accueil|À propos|Actualités|Contact|Connexion|Se connecter|Recherche|Aide|Guides|Thèmes|Agenda|Tarifs|Produits|Emplois|Presse|Archives|Mon compte|Services|Forum|S’inscrire|Boutique|Culture|Économie|Sports|Blog",
    "pt": "Início|Sobre nós|Notícias|Contato|Entrar|Pesquisar|Ajuda|Guias|Temas|Agenda|Preços|Produtos|Imprensa|Arquivo|Minha conta|Loja|Cultura|Economia|Esportes",
    "it": "Home|Chi siamo|Notizie|Contatti|Accedi|Cerca|Aiuto|Guide|Temi|Eventi|Prezzi|Prodotti|Stampa|Archivio|Carrello|Cultura|Economia|Sport",
    "pl": "Strona główna|O nas|Aktualności|Kontakt|Zaloguj się|Szukaj|Pomoc|Poradniki|Tematy|Wydarzenia|Cennik|Produkty|Prasa|Archiwum|Koszyk|Kultura|Gospodarka|Sport",
    "ru": "Главная|О нас|О компании|Новости|Контакты|Войти|Регистрация|Поиск|Помощь|Темы|События|Цены|Продукты|Услуги|Вакансии|Пресса|Архив|Личный кабинет|Форум|Корзина|Культура|Экономика|Спорт",
}
FOOT = {
    "en": "Privacy policy|Privacy|Terms of use|Terms of service|Terms & conditions|Imprint|Legal notice|Legal|Cookie settings|Cookie preferences|Accessibility|Sitemap|Help|RSS|Partners|Contact|Careers|Advertise|Cookie policy|Disclaimer|Do Not Sell or Share My Personal Information|Copyright policy|Security|Status|Feedback",
    "de": "Datenschutz|Datenschutzerklärung|Impressum|Nutzungsbedingungen|Cookie-Einstellungen|Barrierefreiheit|Presse|AGB|Kontakt|Sitemap|Partner|Mediadaten|Widerrufsrecht",
    "es": "Privacidad|Política de privacidad|Aviso legal|Condiciones de uso|Política de cookies|Accesibilidad|Mapa web|Prensa|Contacto|Publicidad",
    "fr": "Confidentialité|Politique de confidentialité|Mentions légales|Conditions d’utilisation|Gestion des cookies|Accessibilité|Plan du site|Presse|Contact|Partenaires|Publicité",
    "pt": "Privacidade|Política de privacidade|Aviso legal|Termos de uso|Política de cookies|Acessibilidade|Mapa do site|Imprensa|Anuncie",
    "it": "Privacy|Informativa sulla privacy|Note legali|Condizioni d’uso|Impostazioni cookie|Accessibilità|Mappa del sito|Stampa|Pubblicità",
    "pl": "Prywatność|Polityka prywatności|Nota prawna|Regulamin|Ustawienia plików cookie|Dostępność|Mapa strony|Prasa|Reklama",
    "ru": "Политика конфиденциальности|Условия использования|Пользовательское соглашение|Правовая информация|Настройки файлов cookie|Карта сайта|Пресса|Контакты|Реклама|Обратная связь",
}
WIDGETS = {
    "en": "Most read|Most popular|Latest posts|Latest news|Recent posts|Recent comments|Related articles|Related posts|You might also like|Popular posts|Categories|Tags|Topics|Archives|Trending|More from this author|Recommended for you|Read next|Follow us|Editor’s picks|In this section|Quick links|Share this|Comments|Top stories|More stories",
    "de": "Meistgelesen|Neueste Artikel|Kategorien|Schlagwörter|Das könnte Sie auch interessieren|Ähnliche Artikel|Themen|Neueste Kommentare|Beliebte Beiträge|Mehr zum Thema|Folgen Sie uns",
    "es": "Más leídas|Lo más visto|Entradas recientes|Categorías|Etiquetas|También te puede interesar|Artículos relacionados|Temas|Comentarios recientes|Síguenos|Más noticias",
    "fr": "Articles populaires|Articles récents|Catégories|Étiquettes|Vous aimerez aussi|Articles liés|Sur le même sujet|Thèmes|Commentaires récents|Suivez-nous",
    "pt": "Mais lidas|Posts recentes|Categorias|Etiquetas|Leia também|Você também pode gostar|Siga-nos",
    "it": "I più letti|Articoli recenti|Categorie|Etichette|Potrebbe interessarti anche|Articoli correlati|Seguici",
    "pl": "Najczęściej czytane|Ostatnie wpisy|Kategorie|Tagi|Zobacz także|Podobne artykuły|Obserwuj nas",
    "ru": "Популярное|Самое читаемое|Последние записи|Свежие комментарии|Рубрики|Метки|Похожие статьи|Читайте также|Мы в соцсетях|Ещё по теме",
}
#: {site} is the site's name, {place} a place, {n} a number, {title} another page's title; other names are of ``PARTS``.
CONSENT = {
    "en": "This website uses cookies to {aim}. {out}|{we} cookies and similar technologies to {aim}. {out}|{site} uses cookies to {aim}. {out}|{we} cookies to {aim} and to {aim}. {out}|{free}, {we2} cookies to {aim}. {out}|We and our {n} partners {keep} to {aim}. {out}|Our pages and those of our partners {keep} to {aim}. {out}|By clicking “Accept”, you agree to the storing of cookies on your device to {aim}.|By continuing to use this site, you consent to our use of cookies.|Pages on {site} {keep} to {aim}. {out}|These pages {keep} to {aim}. {out}|The services that you use here {keep} to {aim}. {out}|We value your privacy. {we} cookies to {aim}. {out}|Your privacy is important to us. With your permission, we {keep} to {aim}. {out}",
    "de": "Diese Website verwendet Cookies, um {aim}. {out}|{we} Cookies und ähnliche Technologien, um {aim}. {out}|{site} verwendet Cookies, um {aim}. {out}|Wir und unsere {n} Partner {keep}, um {aim}. {out}|Unsere Seiten {keep}, um {aim}. {out}|Die Seiten und Dienste von {site} {keep}, um {aim}. {out}|Mit Ihrer Einwilligung {keep} wir, um {aim}. {out}|Durch die weitere Nutzung der Seite stimmen Sie der Verwendung von Cookies zu.|Wir schätzen Ihre Privatsphäre. {out}",
    "es": "Este sitio web utiliza cookies para {aim}. {out}|{we} cookies propias y de terceros para {aim}. {out}|En {site} {keep} para {aim}. {out}|Nosotros y nuestros {n} socios {keep} para {aim}. {out}|Para financiar {site}, {keep} para {aim}. {out}|Si continúa navegando, consideramos que acepta su uso.|Valoramos tu privacidad. {out}",
    "fr": "Ce site utilise des cookies pour {aim}. {out}|{we} des cookies et des technologies similaires pour {aim}. {out}|Sur {site}, nous {keep} pour {aim}. {out}|Nous et nos {n} partenaires {keep} pour {aim}. {out}|Pour financer ce site, nous {keep} pour {aim}. {out}|En poursuivant votre navigation, vous acceptez l’utilisation de cookies.|Nous respectons votre vie privée. {out}",
    "pt": "Este site usa cookies para {aim}. {out}|{we} cookies e tecnologias semelhantes para {aim}. {out}|No {site} {keep} para {aim}. {out}|Nós e os nossos {n} parceiros {keep} para {aim}. {out}|Ao continuar a navegar, você concorda com o uso de cookies.",
    "it": "Questo sito utilizza i cookie per {aim}. {out}|{we} cookie propri e di terze parti per {aim}. {out}|Noi e i nostri {n} partner {keep} per {aim}. {out}|Proseguendo la navigazione acconsenti all’uso dei cookie.",
    "pl": "Ta strona używa plików cookie, aby {aim}. {out}|{we} plików cookie i podobnych technologii, aby {aim}. {out}|My i nasi {n} partnerzy {keep}, aby {aim}. {out}|Korzystając dalej ze strony, wyrażasz zgodę na używanie plików cookie.",
    "ru": "Этот сайт использует файлы cookie, чтобы {aim}. {out}|{we} файлы cookie и похожие технологии, чтобы {aim}. {out}|Мы и наши партнёры ({n}) {keep}, чтобы {aim}. {out}|Продолжая пользоваться сайтом, вы соглашаетесь на использование файлов cookie.",
}
PARTS = {
    "en": {
        "we": "We use|We sometimes use|Like most sites, we use|We only use", "we2": "we use|we rely on|we set", "free": "To keep our content free|To run this site|For the best experience|To make this service better",
        "aim": "ensure you get the best experience|improve your browsing experience|analyze our traffic|personalize content and ads|understand where our visitors come from|provide social media features|remember your settings|deliver relevant advertising|keep the site secure|measure the performance of ads|recognise you when you return|count visits|load pages faster|show you content you like",
        "keep": "use cookies|store and access information on a device|use cookies and other identifiers|process personal data|keep small text files in your browser|save data on your computer|rely on trackers", "out": "||Learn more.|Find out more in our cookie policy.|You can withdraw your consent at any time.|You can change your preferences in the settings.|See our privacy policy for details.|Please choose which cookies we may use.|If you stay on this site, you accept them.",
    },
    "de": {"we": "Wir verwenden|Wir nutzen|Wir setzen", "aim": "Ihnen das beste Nutzererlebnis zu bieten|unseren Datenverkehr zu analysieren|Inhalte und Anzeigen zu personalisieren|die Website zu verbessern|Ihre Einstellungen zu speichern|die Reichweite zu messen", "keep": "verarbeiten personenbezogene Daten|nutzen Cookies|speichern Informationen auf Ihrem Gerät|setzen Cookies ein", "out": "||Mehr erfahren.|Weitere Informationen finden Sie in unserer Datenschutzerklärung.|Sie können Ihre Einwilligung jederzeit widerrufen.|Ihre Auswahl können Sie in den Einstellungen ändern."},
    "es": {"we": "Utilizamos|Usamos|Empleamos", "aim": "mejorar su experiencia de navegación|analizar nuestro tráfico|personalizar el contenido y los anuncios|recordar sus ajustes|ofrecer funciones de redes sociales|medir la audiencia", "keep": "utilizamos cookies|almacenamos información en un dispositivo|tratamos datos personales", "out": "||Más información.|Consulte nuestra política de cookies.|Puede retirar su consentimiento en cualquier momento.|Puede cambiar la configuración."},
    "fr": {"we": "Nous utilisons|Nous employons", "aim": "améliorer votre expérience|analyser notre trafic|personnaliser le contenu et les annonces|mémoriser vos préférences|proposer des fonctions de réseaux sociaux|mesurer la fréquentation", "keep": "utilisons des cookies|stockons des informations sur votre appareil|traitons des données personnelles", "out": "||En savoir plus.|Consultez notre politique de confidentialité.|Vous pouvez retirer votre consentement à tout moment.|Vous pouvez modifier vos préférences."},
    "pt": {"we": "Usamos|Utilizamos", "aim": "melhorar a sua experiência|analisar o tráfego|personalizar conteúdo e anúncios|lembrar as suas preferências", "keep": "usamos cookies|armazenamos informações no seu dispositivo|tratamos dados pessoais", "out": "||Saiba mais.|Consulte a nossa política de privacidade.|Você pode alterar as suas preferências a qualquer momento."},
    "it": {"we": "Utilizziamo|Usiamo", "aim": "migliorare la tua esperienza|analizzare il traffico|personalizzare contenuti e annunci|ricordare le tue preferenze", "keep": "utilizziamo cookie|archiviamo informazioni su un dispositivo|trattiamo dati personali", "out": "||Scopri di più.|Leggi la nostra informativa.|Puoi revocare il consenso in qualsiasi momento."},
    "pl": {"we": "Używamy|Korzystamy z", "aim": "poprawić komfort przeglądania|analizować ruch|dostosować treści i reklamy|zapamiętać ustawienia", "keep": "używają plików cookie|przechowują informacje na urządzeniu|przetwarzają dane osobowe", "out": "||Dowiedz się więcej.|Szczegóły znajdziesz w polityce prywatności.|Zgodę można wycofać w dowolnej chwili."},
    "ru": {"we": "Мы используем|Мы применяем", "aim": "сайт работал лучше|анализировать посещаемость|показывать подходящую рекламу|запоминать ваши настройки", "keep": "используем файлы cookie|храним данные на вашем устройстве|обрабатываем персональные данные", "out": "||Подробнее.|Подробности в политике конфиденциальности.|Вы можете отозвать согласие в любой момент."},
}
BUTTONS = {
    "en": "Accept all|Accept|Accept all cookies|Reject|Reject all|Decline|Manage preferences|Necessary only|Got it|I agree|Customise|Settings|Cookie settings|Save choices|OK",
    "de": "Akzeptieren|Alle Cookies akzeptieren|Zustimmen|Ablehnen|Alle ablehnen|Einstellungen|Nur notwendige|Auswahl speichern|Verstanden",
    "es": "Aceptar|Aceptar todas|Rechazar|Rechazar todas|Configurar|Ajustes|Guardar|De acuerdo",
    "fr": "Accepter|J’accepte|Accepter et fermer|Refuser|Tout refuser|Personnaliser|Paramétrer|Enregistrer",
    "pt": "Aceitar|Aceitar todos|Recusar|Configurar|Entendi",
    "it": "Accetta|Accetta tutti|Rifiuta|Personalizza|Ho capito",
    "pl": "Akceptuję|Zgadzam się|Odrzuć|Ustawienia|Rozumiem",
    "ru": "Принять|Принять все|Согласен|Отклонить|Настроить|Понятно",
}
PROMPTS = {
    "en": "Advertisement|Sponsored content|Promoted|Article continues after advertisement|Continue reading|Keep reading|Read more|Save this article|Bookmark|Follow this author|Share|Share on Facebook|Share on X|Share this article|Share via email · Print|Facebook | Twitter | LinkedIn | Email|Was this article helpful?|Did you find this useful? Yes / No|Thank you for your feedback!|★★★★☆ {n} ratings|Rating: {n} votes|{n} Comments · {n} views|{n} minute read|Reading time: {n} minutes|{n} views|{n} shares|No comments yet|Leave a reply|Leave a comment|Post a comment|Reply|Join the discussion|Join the conversation|Become a member to read without limits.|Subscribe now for full access.|You have {n} free articles left this month.|Already a subscriber? Log in|Sign up for our newsletter and get the latest stories by email. Enter your email address.|Never miss a post: subscribe to our mailing list.|Subscribe to our newsletter|Sign up for free|Your email address will not be published.|Log in to comment|Image credit: {site}|Photo: loading|Loading…|Please wait|Scroll to top|Back to top ↑|Go to top|Print|Print this page|Skip to main content|Skip to content|Toggle navigation|Close menu|Open menu|Please enable JavaScript to continue.|Listen to this article|Watch the video|Enjoyed this post? Share it with friends.|Stay in the loop: enter your email and press Subscribe.|Get our weekly digest in your inbox.|The best stories, delivered to your inbox every Friday.|Become a supporter and enjoy unlimited access.|Members read without ads: join today.|Enjoy unlimited reading: start your free trial.|Are you enjoying our work? Support us.|Rate this article|Rate this: ★★★★★|Please rate this page|Like this page? Consider a donation.|Help us keep writing: donate today.|Show more|Load more comments|View all|See all|Copy URL|Tweet|Report this comment|Posted in News|Filed under: {place}|Tagged with {place}|Previous article: {title}|Next article: {title}|See also: {title}|More on this: {title}|Related article: {title}|Recommended: {title}|← {title}|{title} →",
    "de": "Anzeige|Werbung|Weiterlesen|Mehr lesen|Teilen|Teilen: E-Mail · Facebook|War dieser Artikel hilfreich?|{n} Kommentare|Lesedauer: {n} Minuten|Newsletter abonnieren|Melden Sie sich für unseren Newsletter an und erhalten Sie Neues per E-Mail.|Zum Seitenanfang|Zum Inhalt springen|Drucken|Merken|Mehr anzeigen|Kommentar schreiben|Jetzt registrieren|Kostenlos testen|Mehr zum Thema: {title}|Auch interessant: {title}|Siehe auch: {title}",
    "es": "Publicidad|Continuar leyendo|Leer más|Compartir|Compartir en Facebook · Correo|¿Le ha resultado útil este artículo?|{n} comentarios|Tiempo de lectura: {n} minutos|Suscríbase a nuestro boletín|Suscríbete y recibe las novedades en tu correo.|Ir arriba|Ir al contenido|Imprimir|Guardar|Mostrar más|Deja un comentario|Te puede interesar: {title}|Ver también: {title}",
    "fr": "Publicité|Lire plus|Partager|Partager sur Facebook · E-mail|Cet article vous a-t-il été utile ?|{n} commentaires|Temps de lecture : {n} minutes|Abonnez-vous à notre newsletter|Inscrivez-vous pour recevoir nos articles par e-mail.|Retour en haut|Aller au contenu principal|Imprimer|Enregistrer|Afficher plus|Laisser un commentaire|À lire également : {title}|Voir aussi : {title}",
    "pt": "Publicidade|Continue lendo|Leia mais|Compartilhar|Este artigo foi útil?|{n} comentários|Assine a nossa newsletter|Voltar ao topo|Pular para o conteúdo|Imprimir|Deixe um comentário|Leia também: {title}",
    "it": "Pubblicità|Continua a leggere|Leggi tutto|Condividi|Questo articolo ti è stato utile?|{n} commenti|Iscriviti alla newsletter|Torna in alto|Vai al contenuto|Stampa|Lascia un commento|Leggi anche: {title}",
    "pl": "Reklama|Czytaj dalej|Czytaj więcej|Udostępnij|Czy ten artykuł był pomocny?|{n} komentarzy|Zapisz się do newslettera|Wróć na górę|Przejdź do treści|Drukuj|Dodaj komentarz|Zobacz także: {title}",
    "ru": "Реклама|Читать далее|Читать дальше|Поделиться|Была ли статья полезной? Да Нет|Комментарии ({n})|{n} просмотров|Время чтения: {n} минут|Подпишитесь на рассылку|Подпишитесь на наш канал и получайте новости первыми.|Наверх|Перейти к содержанию|Версия для печати|Показать ещё|Оставить комментарий|Войдите, чтобы оставить комментарий.|Читайте также: {title}|Смотрите также: {title}",
}
CLOSING = {
    "en": "© {y} {site}. All rights reserved.|Copyright © {y} {site}|© {site} {y}|© {y}–{y} {site}, Inc.|{site} © {y} – No part of this site may be reproduced without written permission.|Content is available under a Creative Commons license unless otherwise noted.|{site}, {n} Main Street, {place}|{site} Ltd, registered in {place}, company number {n}|Copyright {y} by {site}. Reproduction without permission is prohibited.|{site} is operated by {place} Media Group, {n} Park Road, {place}. No warranty is given.|Powered by {site}|Theme by {site}|Designed and hosted in {place}|Version {n}.{n}.{n}|{site} is a trademark of its owner in {place} and elsewhere.|{site} is published by a non-profit organisation based in {place}. The information is provided as is, without warranty.|Follow us on social media|Tel. +{n} {n} {n}|Last updated: {y}",
    "de": "© {y} {site}. Alle Rechte vorbehalten.|© {y} {site} GmbH|{site} GmbH, Hauptstraße {n}, {place}|Ein Angebot von {site}.|Betreiber dieser Seite ist {site} in {place}.",
    "es": "© {y} {site}. Todos los derechos reservados.|© {y} {site} S. L.|{site}, calle Mayor {n}, {place}|Un proyecto de {site}.",
    "fr": "© {y} {site}. Tous droits réservés.|© {y} {site} SARL|{site}, {n} rue de la République, {place}|Un site édité par {site}.",
    "pt": "© {y} {site}. Todos os direitos reservados.|{site}, Avenida Central {n}, {place}",
    "it": "© {y} {site}. Tutti i diritti riservati.|{site}, via Roma {n}, {place}",
    "pl": "© {y} {site}. Wszelkie prawa zastrzeżone.|{site}, ul. Główna {n}, {place}",
    "ru": "© {y} {site}. Все права защищены.|{site}, ул. Центральная, {n}, {place}|Копирование материалов только со ссылкой на {site}.",
}
#: Articles may speak of such things, and have such headings, and are content all the same.
SPOKEN_OF = (
    "Browsers delete cookies without an expiry date when the window is closed.",
    "In the study, {n} percent of the visitors rejected cookies when both buttons had the same size.",
    "The privacy policy was rewritten after the court’s ruling.",
    "A newsletter with {n} subscribers was sent every week until {n}.",
    "Users opened the menu {n} times a day on average.",
    "The footer repeats the address of the office.",
    "Readers may subscribe to the feed of changes.",
    "Spending on advertisement fell by {n} percent in {place}.",
    "The site map of the excavation shows two houses.",
    "Comments on the draft were accepted for {n} days.",
    "The terms of use of the archive forbid copies.",
    "They share the data with {n} partners.",
    "Click the second tab and press Save to keep the change.",
    "You can change the threshold in the settings of the program.",
    "See also the second table.",
    "All rights to the letters stay with the family.",
    "Related work came to the same result in {n}.",
    "Accept all invitations that come from {place}.",
    "Log in as an administrator and open the search page.",
)
HEADINGS = "Contact|Support|Search|Topics|Archive|Events|Related work|About the data|Downloads|Help|Comments|Privacy|Terms|References|Further reading|Products|News|Cookies|Newsletter"

#: Short articles in several languages, so that running text is known by more than one table's words; a line is a paragraph.
ARTICLES = (
    ("What a cookie banner must say", "Since the rules came into force, a site must ask before it stores cookies that are not needed.\nConsent has to be given freely.\nA button to reject must be as easy to find as the one to accept.\nMany banners still hide it behind a second page.\nRegulators have fined several companies for that.\n## What counts as necessary\nA shopping cart needs a cookie.\nAdvertising does not."),
    ("How newsletters are measured", "An opened letter loads a small picture.\nThe sender counts how often that happens.\nPrivacy settings of mail programs now load the picture for everybody.\nThe count has therefore lost its meaning.\nClicks still tell something."),
    ("Baking bread with rye", "Rye flour takes up more water than wheat.\nMix the sourdough with warm water and let it stand overnight.\n- 500 g rye flour\n- 400 ml water\n- 10 g salt\nKnead it briefly.\nBake the loaf for fifty minutes.\nIt keeps for a week."),
    ("The lighthouse keeper’s winter", "Nobody came to the island between November and March.\nThe keeper lit the lamp at dusk and wrote down the weather.\nHis letters are kept in the museum today.\nSome are hard to read.\nIn one of them he asks for tobacco and for news."),
    ("Setting up two-factor login", "Open the account page and choose Security.\nScan the code with your phone.\nThe app shows six digits.\nEnter them before they change.\n1. Keep the recovery codes in a safe place.\n2. Remove old devices.\nSupport cannot restore an account without them."),
    ("Warum Züge im Herbst rutschen", "Nasses Laub legt sich auf die Schienen.\nDie Räder drehen dann durch, und der Zug braucht länger zum Bremsen.\nLokführer streuen Sand.\nDas hilft meistens.\nManche Strecken werden im Oktober täglich gereinigt."),
    ("Der Garten im März", "Die Beete sind noch kalt.\nWer früh sät, deckt die Erde mit Vlies ab.\n- Spinat\n- Radieschen\n- Erbsen\nGegossen wird am Morgen.\nNachts friert es oft noch."),
    ("Cookies und Einwilligung", "Eine Seite darf nicht notwendige Cookies erst setzen, wenn jemand zugestimmt hat.\nDas Ablehnen muss so einfach sein wie das Annehmen.\nViele Banner erfüllen das nicht.\n## Was die Gerichte sagen\nEin vorausgefülltes Feld ist keine Einwilligung."),
    ("Die Brücke am alten Hafen", "Im Jahr 1902 wurde sie gebaut.\nSie trug zuerst nur eine Straßenbahn.\nNach dem Krieg fehlte das Geld für eine neue.\nHeute steht sie unter Denkmalschutz.\nKinder springen im Sommer von ihr ins Wasser."),
    ("Pourquoi le pain rassit", "L’amidon perd son eau et durcit.\nLe froid accélère ce phénomène.\nIl vaut mieux garder le pain à température ambiante.\nUn torchon suffit.\nLe lendemain, on peut le griller."),
    ("Une école au bord de la mer", "Elle n’avait que douze élèves.\nLe maître venait à vélo, même sous la pluie.\nL’hiver, on allumait le poêle à sept heures.\n## Après la guerre\nL’école ferma en 1951.\nLe bâtiment abrite aujourd’hui une bibliothèque."),
    ("Le consentement aux cookies", "Un site doit demander l’accord du visiteur avant de déposer un traceur.\nRefuser doit être aussi simple qu’accepter.\nBeaucoup de bandeaux ne respectent pas cette règle.\nDes amendes ont été prononcées.\nLe sujet reste débattu."),
    ("Cómo cuidar un olivo", "El olivo necesita sol y poca agua.\nSe poda a finales del invierno.\nLas ramas secas se cortan primero.\n- Tijeras limpias\n- Guantes\nEn verano se riega una vez por semana.\nLos frutos llegan en otoño."),
    ("El faro de la isla", "Se encendió por primera vez en 1867.\nEl farero vivía allí con su familia.\nHoy funciona solo.\nLos visitantes suben por una escalera estrecha.\nDesde arriba se ve la costa."),
    ("Qué es el consentimiento", "La ley exige que el usuario pueda rechazar las cookies con la misma facilidad.\nMuchos avisos no lo cumplen.\nLa agencia ha impuesto multas.\nEl debate continúa."),
    ("A feira de domingo", "Começa às seis da manhã.\nOs produtores trazem frutas, queijo e pão.\nQuem chega tarde encontra pouco.\nÀ tarde a praça fica vazia.\nResta o cheiro de café."),
    ("Como guardar sementes", "As sementes devem secar à sombra.\nDepois vão para um frasco fechado.\n1. Escreva o nome.\n2. Anote o ano.\nAssim duram muito tempo."),
    ("Il forno del paese", "Apre alle quattro del mattino.\nIl pane esce caldo e dura tre giorni.\nUna volta ogni famiglia portava il proprio impasto.\nOggi restano due forni.\nIl sabato c’è la fila."),
    ("La neve sulle Alpi", "Negli ultimi anni ne cade meno.\nI ghiacciai arretrano.\n## Le misure\nGli studiosi misurano lo spessore in primavera.\nI dati risalgono al 1920."),
    ("Stary młyn nad rzeką", "Zbudowano go w 1840 roku.\nMełł zboże dla trzech wsi.\nPo wojnie stał pusty.\nDziś mieści się w nim muzeum.\nLatem przyjeżdżają tu szkoły."),
    ("Jak zaparzyć herbatę", "Woda nie może wrzeć zbyt długo.\nLiście zalewa się na trzy minuty.\n- czajnik\n- filiżanka\nPotem trzeba je wyjąć.\nGorzka herbata smakuje niewielu."),
    ("Старый маяк", "Маяк построили в 1874 году.\nСмотритель жил там с семьёй.\nЗимой к острову не ходили лодки.\nПисьма приходили только весной.\nСейчас в башне музей."),
    ("Как хранить хлеб", "Хлеб не любит холода.\nЛучше завернуть его в полотно.\n- полотенце\n- деревянная хлебница\nТак он остаётся мягким два дня.\nПотом из него делают сухари."),
    ("Согласие на файлы cookie", "Сайт должен спросить разрешения, прежде чем сохранить лишние файлы.\nОтказаться должно быть так же просто, как согласиться.\nНе все это соблюдают.\nСпоры продолжаются."),
    ("De oude haven", "Vroeger lagen hier tientallen schepen.\nNu wonen er mensen aan de kade.\nDe kraan is blijven staan.\nKinderen vissen er in de zomer.\nHet water is weer schoon."),
)

_BULLET = re.compile(r"(?:[-*•+]|\d+[.)])\s+")
_WORD = re.compile(r"[^\W\d_]+|\d+|[©®™★↑→»›|·•]")


def web_pages(df: DataFrame) -> Column:
    """Documents taken from web pages: by their type, or by an address when they are no repository."""
    kind = F.coalesce(F.lower(F.trim("source_type")), F.lit(""))
    return ((kind == "web") | (F.col("source_url").isNotNull() & (kind != "repository"))) & (F.length("raw_text") > 0)


def _kind(s: str) -> str:
    """What a line looks like in the text: heading, item, code, row, prose or short."""
    if re.match(r"#{1,6}\s", s):
        return "heading"
    if s.startswith(("```", "~~~")):
        return "fence"
    if s.startswith("|") and s.endswith("|") and len(s) > 2:
        return "row"
    if _BULLET.match(s):
        return "item"
    n = len(s.split())
    return "prose" if n >= 9 and s[-1:] in ".!?:;”\"" else "long" if n >= 9 else "short"


class Page:
    """Lines of a page with their evidence, and the tree above them."""

    def __init__(self, text: str, title: str | None, url: str | None) -> None:
        self.lines = [x.strip() for x in text.split("\n")]
        self.at = [i for i, x in enumerate(self.lines) if x]
        kinds = [_kind(self.lines[i]) for i in self.at]
        fenced, inside = [], False
        for k in kinds:
            inside ^= k == "fence"
            fenced.append(inside or k == "fence")
        self.kinds = ["code" if f else k for k, f in zip(kinds, fenced)]
        #: The last line that is surely running text or a table; where all sentences are short, the last of them.
        prose = {n: len(self.lines[self.at[n]].split()) for n, k in enumerate(self.kinds) if k == "prose"}
        least = min(18, max(prose.values(), default=0) - 1)
        self.last = max((n for n, k in enumerate(self.kinds) if k in ("code", "row") or prose.get(n, 0) > least), default=-1)
        self._tree()
        self.features = self._features(title or "", url or "")

    def _tree(self) -> None:
        """``section`` and ``block`` of each line, by number."""
        self.section, self.block = [], []
        section = block = -1
        for n, i in enumerate(self.at):
            kind, line = self.kinds[n], self.lines[i]
            nxt = self.kinds[n + 1] if n + 1 < len(self.at) else "end"
            opens = kind == "heading" or (kind == "short" and len(line.split()) <= 5 and nxt in ("item", "short") and (n == 0 or self.kinds[n - 1] not in ("short", "item") or self.at[n - 1] < i - 1 and self.kinds[n - 1] != "short"))
            if opens or section < 0:
                section += 1
                block += 1
            elif self.at[n - 1] < i - 1 or self.kinds[n - 1] != kind or kind == "prose":
                same = self.kinds[n - 1] == kind and kind in ("item", "short", "code", "row")
                block += not same
            self.section.append(section)
            self.block.append(block)

    def _features(self, title: str, url: str) -> list[list[tuple[str, float]]]:
        site = re.sub(r"^www\.|\.[a-z]+$", "", re.sub(r"^\w+://", "", url).split("/")[0].lower())
        names = set(_WORD.findall(title.lower()))
        heads = [n for n, i in enumerate(self.at) if re.match(r"#\s", self.lines[i])]
        bare = re.sub(r"\W+", "", title.lower())
        heads = [n for n in heads if bare and re.sub(r"\W+", "", self.lines[self.at[n]].lower()) == bare] or heads
        head = heads[0] if heads else -1
        total = len(self.at)
        out = []
        for n, i in enumerate(self.at):
            line, kind = self.lines[i], self.kinds[n]
            low = line.lower()
            words = _WORD.findall(low)
            size = 0 if not words else 1 if len(words) == 1 else 2 if len(words) == 2 else 3 if len(words) < 5 else 4 if len(words) < 9 else 5 if len(words) < 16 else 6
            before = self.kinds[n - 1] if n else "start"
            after = self.kinds[n + 1] if n + 1 < total else "end"
            place = "before" if n < head else "head" if n == head else "none" if head < 0 else "body" if n <= self.last else "tail"
            same = re.sub(r"\W+", "", low)
            shared = len(names & set(words)) / max(1, len(set(words)))
            f = ["bias", f"kind={kind}", f"size={size}", f"place={place}", f"place={place},kind={kind}", f"place={place},size={size}", f"kind={kind},after={after}", f"kind={kind},before={before}", f"place={place},kind={kind},after={after}"]
            if kind == "heading":
                level = len(line) - len(line.lstrip("#"))
                f += [f"level={level}", f"level={level},after={after}", f"level={level},place={place}"]
            if bare:
                f.append("title=" + ("same" if same == bare else "part" if shared > 0.6 and len(words) > 1 else "start" if len(same) > 8 and any(len(p) > 8 and bare.startswith(p) for p in re.split(r"[\W_]*[»›/>|•·][\W_]*", low) if p) else "no"))
            if site:
                f.append("site=" + ("same" if same == site else "in" if site in same.replace(" ", "") else "no"))
            marks = "".join(sorted({c for c in line if c in "|·•/»›>[]©★↑™®"}))
            if marks and kind not in ("code", "row"):
                f += [f"marks={marks}", f"marks={marks},size={size}"]
            if "  " in line and kind not in ("code", "row"):
                f.append("gaps")
            f.append("end=" + (line[-1] if not line[-1].isalnum() else "word"))
            if line[-1] in ".?!" and kind in ("prose", "short", "long"):
                f += [f"sentence,size={size}", f"sentence,place={place},before={before}"]
            # Whether a blank line sets it apart, on pages that have any.
            apart = "never" if total == len(self.lines) else "first" if not n else "yes" if self.at[n - 1] < i - 1 else "no"
            f += [f"apart={apart},kind={kind},before={before}", f"apart={apart},place={place},before={before}"]
            if n > total - 4:
                f.append(f"end-{total - n}")
            if n < 3:
                f.append(f"start-{n}")
            values = [(x, 1.0) for x in f]
            if kind not in ("code", "row"):
                uni = {f"w={w}" if not w.isdigit() else "w=0" for w in words}
                pair = {f"p={a} {b}" for a, b in zip(words, words[1:])} if len(words) < 40 else set()
                v = 1.5 / max(1.0, len(words)) ** 0.5
                values += [(x, v) for x in uni | pair]
                if size <= 4:
                    values.append((f"line={' '.join('0' if w.isdigit() else w for w in words)}", 1.0))
            out.append(values)
        return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % _DIMENSIONS


class PageModel:
    """Line weights and the potentials of the tree; 1 is content, 0 is boilerplate."""

    def __init__(self, pages: list[tuple[Page, list[int]]], rounds: int = 160, decay: float = 2e-6) -> None:
        known: dict[str, int] = {}
        at, value, row, y = [], [], [], []
        for page, labels in pages:
            for f, label in zip(page.features, labels):
                for name, v in f:
                    k = known.get(name)
                    if k is None:
                        k = known[name] = _slot(name)
                    at.append(k)
                    value.append(v)
                    row.append(len(y))
                y.append(label)
        at, value, row, y = np.asarray(at), np.asarray(value), np.asarray(row), np.asarray(y, float)
        w, seen = np.zeros(_DIMENSIONS), np.full(_DIMENSIONS, 1e-3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.bincount(row, w[at] * value, len(y))))
            g = np.bincount(at, (p - y)[row] * value, _DIMENSIONS) / len(y) + decay * w
            seen += g * g
            w -= 0.5 * g / np.sqrt(seen)
        self.w = w.astype(np.float32)
        # Inner nodes carry the label of most lines below them.
        pairs = {"page": np.ones((2, 2)), "section": np.ones((2, 2)), "block": np.ones((2, 2))}
        for page, labels in pages:
            up = np.asarray(labels)
            block = _majority(page.block, up)
            of = dict(zip(page.block, page.section))
            section = _majority(page.section, up)
            for b, x in block.items():
                pairs["section"][section[of[b]], x] += 1
            for x in section.values():
                pairs["page"][1, x] += 1
            for b, x in zip(page.block, labels):
                pairs["block"][block[b], x] += 1
        self.pairs = {k: TEMPER[k] * np.log(m / m.sum(1, keepdims=True)) for k, m in pairs.items()}
        # The model of a line already knows how common its label is.
        share = y.mean()
        self.prior = np.log([1 - share, share])
        self.known = known

    def evidence(self, page: Page) -> np.ndarray:
        out = np.zeros((len(page.features), 2))
        known, w = self.known, self.w
        for i, f in enumerate(page.features):
            s = 0.0
            for name, v in f:
                k = known.get(name)
                if k is not None:
                    s += w[k] * v
            out[i] = -np.logaddexp(0, s), -np.logaddexp(0, -s)
        return out

    def content(self, page: Page) -> np.ndarray:
        """The marginal probability of being content of each line that isn't blank."""
        n = len(page.at)
        if not n:
            return np.zeros(0)
        own = self.evidence(page) - 0.5 * self.prior
        block, section = np.asarray(page.block), np.asarray(page.section)
        of = np.zeros(block.max() + 1, int)
        of[block] = section
        pair = self.pairs
        # Up: what the lines tell their block, the blocks their section, the sections the page.
        tell = np.logaddexp.reduce(pair["block"][None] + own[:, None, :], axis=2)
        at_block = np.zeros((len(of), 2))
        np.add.at(at_block, block, tell)
        tell_b = np.logaddexp.reduce(pair["section"][None] + at_block[:, None, :], axis=2)
        at_section = np.zeros((section.max() + 1, 2))
        np.add.at(at_section, of, tell_b)
        tell_s = np.logaddexp.reduce(pair["page"][None] + at_section[:, None, :], axis=2)
        at_page = tell_s.sum(0)
        # Down: each child hears its parent without what it told itself.
        hear_s = np.logaddexp.reduce((at_page - tell_s)[:, :, None] + pair["page"][None], axis=1)
        hear_b = np.logaddexp.reduce((hear_s + at_section)[of][:, :, None] - tell_b[:, :, None] + pair["section"][None], axis=1)
        hear = np.logaddexp.reduce((hear_b + at_block)[block][:, :, None] - tell[:, :, None] + pair["block"][None], axis=1)
        m = hear + own
        return np.exp(m[:, 1] - np.logaddexp(m[:, 0], m[:, 1]))


def _majority(group: list[int], labels: np.ndarray) -> dict[int, int]:
    g = np.asarray(group)
    share = np.bincount(g, labels) / np.maximum(1, np.bincount(g))
    return {int(k): int(share[k] >= 0.5) for k in np.unique(g)}


#: Short sentences, as a text may end with.
_REMARKS = tuple(x for _, text in ARTICLES for x in text.split("\n") if x[-1] == "." and x[0] not in "-#" and len(x.split()) < 10)


def _general(rng: random.Random) -> tuple[str, str]:
    """One of ``ARTICLES``, its paragraphs apart, in lines, or joined."""
    title, text = rng.choice(ARTICLES)
    lines = text.split("\n")
    if rng.random() < 0.3:
        lines = [x for k in range(0, len(lines), 2) for x in ([" ".join(lines[k : k + 2])] if not any(re.match("[-#0-9]", y) for y in lines[k : k + 2]) else lines[k : k + 2])]
    return title, rng.choice(("\n", "\n\n", "\n\n")).join(lines)


def _shortened(body: str, rng: random.Random) -> str:
    """A few paragraphs of a text, each cut to its first sentence or two; the last one is often a short one."""
    paragraphs = [x for x in body.split("\n") if x.strip()]
    at = rng.randrange(max(1, len(paragraphs) - 3))
    out = []
    for x in paragraphs[at : at + rng.randint(2, 7)]:
        sentences = re.split(r"(?<=[.!?])\s+", x)
        out.append(" ".join(sentences[: rng.randint(1, 2)]))
    return rng.choice(("\n", "\n\n")).join(out)


def _in_no_language(title: str, body: str, rng: random.Random) -> tuple[str, str]:
    """A text with its letters exchanged, vowels for vowels: it looks like text and has no known word."""
    letters = {}
    for group in ("aeiouy", "bcdfghjklmnpqrstvwxz", "аеёиоуыэюя", "бвгджзклмнпрстфхцчшщ"):
        mixed = rng.sample(group, len(group))
        letters |= dict(zip(group, mixed)) | dict(zip(group.upper(), "".join(mixed).upper()))
    table = str.maketrans(letters)
    return title.translate(table), body.translate(table)


def lay_out(documents: list[tuple[str, str]], n: int = TRAINING_PAGES, seed: int = 5, mixed: bool = True) -> list[tuple[str, str, str, list[int]]]:
    """(text, title, url, label of each line that isn't blank): clean documents laid out as pages.

    ``mixed`` adds the articles above, unknown words and short texts by the shares above.
    """
    rng = random.Random(seed)
    titles = [t for t, _ in documents if t] or [t for t, _ in ARTICLES]
    out = []
    for _ in range(n):
        title, body = _general(rng) if mixed and rng.random() < GENERAL else rng.choice(documents)
        title = title or rng.choice(titles)
        if mixed and rng.random() < SHORT:
            body = _shortened(body, rng)
        if mixed and rng.random() < CLOSING_REMARK:
            body = body.rstrip() + rng.choice(("\n", "\n\n")) + (short := rng.choice(_REMARKS)) + (f"\n\n{rng.choice(_REMARKS)}" if len(short) < 50 and rng.random() < 0.5 else "")
        if mixed and rng.random() < UNKNOWN:
            title, body = _in_no_language(title, body, rng)
        lang = rng.choice(("en", "en", "en", "de", "es", "fr", *rng.choices(list(MENU), k=3)))
        site = rng.choice(titles).split()[0][:5].capitalize() + rng.choice(("press", "docs", "notes", "review", "hub", "wiki", "portal", "data", " Journal", "lab", "forum"))
        fill = {"site": site, "place": rng.choice(titles).split()[0].strip(":,").capitalize(), "y": rng.randint(1998, 2026)}

        def say(pool: str) -> str:
            fill["title"] = rng.choice(titles)
            text = rng.choice(pool.split("|"))
            while "{" in text:
                text = re.sub(r"\{(\w+)\}", lambda m: str(rng.randint(2, 900)) if m[1] == "n" else str(fill[m[1]]) if m[1] in fill else rng.choice(PARTS[lang].get(m[1], "").split("|")), text)
            return text.strip()

        def links(pool: str, most: int) -> list[str]:
            items = pool.split("|")
            got = rng.sample(items, rng.randint(min(2, len(items)), min(most, len(items))))
            style = rng.random()
            if style < 0.45:
                sep = rng.choice((" | ", " · ", " • ", " / ", "  ", " – "))
                return [sep.join(got)]
            if style < 0.55:
                return [" ".join(f"[{x}]" for x in got)]
            if style < 0.65:
                return ["Menu: " + ", ".join(got)]
            bullet = rng.choice(("", "", "- ", "* "))
            return [bullet + x for x in got]

        def widget() -> list[str]:
            items = rng.sample(titles, min(len(titles), rng.randint(2, 7)))
            marks = rng.choice((("- ",), ("- ", "", "* "), ("",), ("- ", "* ")))
            return [rng.choice(("### ", "## ", "", "#### ", "")) + say(WIDGETS[lang]), *[rng.choice(marks) + x for x in items]]

        def consent() -> list[str]:
            got = [say(CONSENT[lang])]
            if rng.random() < 0.8:
                buttons = rng.sample(BUTTONS[lang].split("|"), rng.randint(1, 3))
                got += buttons if rng.random() < 0.25 else [rng.choice((" | ", " · ", " ")).join(buttons)]
            return got

        path = [rng.choice((" / ", " » ", " > ", " › ")).join([rng.choice(MENU[lang].split("|")), *([rng.choice(titles).split(":")[0]] if rng.random() < 0.7 else []), title[: rng.choice((24, 28, 99))]])]
        top = [x for x, p in (([site], 0.3), (links(MENU[lang], 10), 0.75), (path, 0.45), (consent(), 0.35), ([say(PROMPTS[lang])], 0.2)) if rng.random() < p]
        rng.shuffle(top)
        middle: list[tuple[str, int]] = []
        for line in body.split("\n"):
            middle.append((line, 1))
            if not line.strip() and rng.random() < 0.04:
                middle += [x for _ in range(rng.randint(1, 3)) for x in ((rng.choice(("# ", "## ", "### ")) + rng.choice(titles), 1), ("", 1))]
            if line.strip() and rng.random() < 0.02:
                middle.append((rng.choice(SPOKEN_OF).format(n=rng.randint(2, 900), place=fill["place"]), 1))
            if not line.strip() and rng.random() < 0.16:
                more = consent() if rng.random() < 0.15 else widget() if rng.random() < 0.08 else [say(PROMPTS[lang])]
                middle += [*[(x, 0) for x in more], ("", 1)]
            if not line.strip() and rng.random() < 0.03:
                middle += [(rng.choice(("## ", "### ")) + rng.choice(HEADINGS.split("|")), 1), ("", 1), (rng.choice(SPOKEN_OF).format(n=rng.randint(2, 900), place=fill["place"]), 1)]
        if rng.random() < 0.08:
            middle += [("", 1), (rng.choice(("## ", "### ")) + rng.choice(titles), 1)]
        under = [x for x, p in (([say(PROMPTS[lang])], 0.5), ([say(PROMPTS[lang])], 0.3), (consent(), 0.15), (widget(), 0.7), (widget(), 0.4), (widget(), 0.15)) if rng.random() < p]
        rng.shuffle(under)
        foot = [x for x, p in ((links(FOOT[lang], 9), 0.8), ([say(CLOSING[lang])], 0.8), ([say(CLOSING[lang])], 0.2), ([site], 0.1)) if rng.random() < p]
        spaced = rng.random()
        rows: list[tuple[str, int]] = []

        def add(groups: list[list[str]]) -> None:
            for g in groups:
                for x in g:
                    rows.append((x, 0))
                    if spaced < 0.3:
                        rows.append(("", 0))
                if spaced < 0.75:
                    rows.append(("", 0))

        add(top)
        has_head = any(re.sub(r"\W+", "", x.lower()) == re.sub(r"\W+", "", title.lower()) for x, _ in middle[:3])
        if not has_head and rng.random() < 0.97:
            rows += [(f"# {title}", 1), ("", 1)]
        rows += middle if spaced < 0.8 else [x for x in middle if x[0].strip()]
        if spaced < 0.8:
            rows.append(("", 1))
        add(under)
        add(foot)
        url = f"https://{rng.choice(('', 'www.'))}{site.lower().replace(' ', '')}.example/a/{rng.randint(1, 999)}" if rng.random() < 0.93 else ""
        out.append(("\n".join(x for x, _ in rows), title, url, [y for x, y in rows if x.strip()]))
    return out


def trained(df: DataFrame) -> PageModel:
    """The model, trained on pages laid out from a bounded sample of documents that are no web pages or scans."""
    kind = F.lower(F.trim("source_type"))
    clean = df.where(F.col("source_url").isNull() & kind.isin("markdown", "text", "docx", "pptx") & ~F.coalesce(F.map_contains_key("metadata", F.lit("page_count")), F.lit(False)) & (F.length("raw_text") > 200))
    # By a hash below the share that gives about the bound: an ordered limit would send that many rows of every partition.
    part = SAMPLE_DOCUMENTS / max(1, clean.count())
    spot = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = clean.where(spot < part).select("id", "title", "raw_text").collect()
    rows.sort(key=lambda r: (r.id or "", r.raw_text))
    documents = [(r.title or "", r.raw_text.replace("\r", "")) for r in rows] or list(ARTICLES)
    return PageModel([(Page(text, title, url), labels) for text, title, url, labels in lay_out(documents)])


def line_labels(df: DataFrame, model: PageModel | None = None) -> DataFrame:
    """(id, line_no, content) for the lines of web pages that aren't blank; ``content`` is the marginal."""
    model = model or trained(df)
    pages = df.where(web_pages(df)).select("id", "title", "source_url", "raw_text").dropDuplicates(["id"])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = sent.value
        for pdf in batches:
            ids, numbers, values = [], [], []
            for i, title, url, text in pdf.itertuples(index=False):
                page = Page(text, title, url)
                ids += [i] * len(page.at)
                numbers += [k + 1 for k in page.at]
                values.append(judge.content(page))
            yield pd.DataFrame({"id": ids, "line_no": numbers, "content": np.concatenate(values) if values else np.zeros(0)})

    return pages.mapInPandas(judged, "id string, line_no int, content double")


def boilerplate(df: DataFrame) -> DataFrame:
    """(id, line_no) of the lines that belong to the page around the main body.

    Null, empty and blank texts give no rows; a missing title, address or type is none. Rows
    of the same id are taken for one delivered twice; other columns are left out.
    """
    return line_labels(df).where(F.col("content") < 0.5).select("id", "line_no")


def main_text(df: DataFrame) -> DataFrame:
    """(id, main_text): each page reduced to its main body, with blank lines as they were but never two in a row."""
    kept = line_labels(df).where(F.col("content") >= 0.5).groupBy("id").agg(F.collect_set("line_no").alias("kept"))
    pages = df.where(web_pages(df)).select("id", "raw_text").dropDuplicates(["id"]).join(kept, "id", "left")
    lines = F.transform(F.split("raw_text", "\n"), lambda x, i: F.when((F.trim(x) == "") | (F.trim(x) == "\r") | F.array_contains(F.coalesce("kept", F.array().cast("array<int>")), i + 1), x))
    text = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    return pages.select("id", F.regexp_replace(F.regexp_replace(text, r"(?:[ \t\r]*\n){3,}", "\n\n"), r"^\s+|\s+$", "").alias("main_text"))
