"""Short texts, written for this package, that the built-in language detector counts its n-grams from."""

TEXTS = {
    "de": """Auf dieser Seite finden Sie Nachrichten, Anleitungen und ein Archiv mit älteren Beiträgen. Wer etwas fragen möchte, schreibt einfach eine kurze Nachricht an die Betreuer; wir antworten meistens innerhalb von zwei Tagen.
Der Dienst ist kostenlos und läuft auf einem kleinen Rechner, der nicht immer erreichbar ist. Bitte haben Sie Geduld, wenn etwas länger dauert. Neue Benutzer können sich anmelden, ohne ihren Namen zu nennen.
Gestern haben wir die Suche verbessert und viele Fehler behoben. Außerdem gibt es jetzt eine Übersicht über alle Dateien, die in den letzten Wochen hochgeladen wurden. Es ist schön, dass so viele Menschen mitmachen und ihr Wissen mit anderen teilen. Für größere Fragen steht das Gespräch jeden Abend offen.""",
    "en": """On this page you will find news, guides and an archive of older posts. If you would like to ask something, just write a short message to the people who look after the site; we usually answer within two days.
The service is free and runs on a small machine that cannot always be reached. Please be patient when things take longer than they should. New users can sign up without giving their names.
Yesterday we made the search better and fixed many errors. There is also an overview of all the files that were uploaded during the last weeks. It is good to see that so many people take part and share what they know with each other. For larger questions the chat is open every evening, and welcome to everyone.""",
    "es": """En esta página encontrará noticias, guías y un archivo con los mensajes más antiguos. Si quiere preguntar algo, escriba un mensaje corto a las personas que cuidan el sitio; normalmente respondemos en dos días.
El servicio es gratuito y funciona en una máquina pequeña que no siempre está disponible. Tenga paciencia cuando las cosas tarden más de lo debido. Los nuevos usuarios pueden registrarse sin dar su nombre.
Ayer mejoramos la búsqueda y corregimos muchos errores. También hay una lista de todos los archivos que se subieron durante las últimas semanas. Es bueno ver que tanta gente participa y comparte lo que sabe con los demás.""",
    "fr": """Sur cette page vous trouverez des nouvelles, des guides et une archive des anciens messages. Si vous voulez poser une question, écrivez simplement un petit mot aux personnes qui s'occupent du site ; nous répondons d'habitude en deux jours.
Le service est gratuit et tourne sur une petite machine qui n'est pas toujours accessible. Merci d'être patient quand les choses prennent plus de temps que prévu. Les nouveaux utilisateurs peuvent s'inscrire sans donner leur nom.
Hier nous avons amélioré la recherche et corrigé beaucoup d'erreurs. Il y a aussi une liste de tous les fichiers qui ont été envoyés pendant les dernières semaines. C'est bien de voir que tant de gens participent et partagent ce qu'ils savent.""",
    "it": """In questa pagina troverete notizie, guide e un archivio dei messaggi più vecchi. Se volete chiedere qualcosa, scrivete un breve messaggio alle persone che curano il sito; di solito rispondiamo entro due giorni.
Il servizio è gratuito e gira su una piccola macchina che non è sempre raggiungibile. Abbiate pazienza quando le cose richiedono più tempo del dovuto. I nuovi utenti possono iscriversi senza dare il proprio nome.
Ieri abbiamo migliorato la ricerca e corretto molti errori. C'è anche un elenco di tutti i file che sono stati caricati nelle ultime settimane. È bello vedere che così tante persone partecipano e condividono quello che sanno.""",
    "nl": """Op deze pagina vindt u nieuws, handleidingen en een archief met oudere berichten. Als u iets wilt vragen, schrijf dan gewoon een kort bericht aan de mensen die de site beheren; we antwoorden meestal binnen twee dagen.
De dienst is gratis en draait op een kleine machine die niet altijd bereikbaar is. Heb alstublieft geduld wanneer iets langer duurt. Nieuwe gebruikers kunnen zich aanmelden zonder hun naam te geven.
Gisteren hebben we het zoeken verbeterd en veel fouten hersteld. Er is nu ook een overzicht van alle bestanden die in de laatste weken zijn geplaatst. Het is fijn om te zien dat zoveel mensen meedoen en hun kennis delen.""",
    "pt": """Nesta página você encontrará notícias, guias e um arquivo com as mensagens mais antigas. Se quiser perguntar alguma coisa, escreva uma mensagem curta para as pessoas que cuidam do site; normalmente respondemos em dois dias.
O serviço é gratuito e funciona em uma máquina pequena que nem sempre está disponível. Tenha paciência quando as coisas demorarem mais do que deviam. Novos usuários podem se inscrever sem dar o nome.
Ontem melhoramos a busca e corrigimos muitos erros. Também há uma lista de todos os arquivos que foram enviados durante as últimas semanas. É bom ver que tantas pessoas participam e compartilham o que sabem.""",
    "pl": """Na tej stronie znajdziesz wiadomości, poradniki i archiwum starszych wpisów. Jeśli chcesz o coś zapytać, napisz krótką wiadomość do osób, które opiekują się stroną; zwykle odpowiadamy w ciągu dwóch dni.
Usługa jest bezpłatna i działa na małym komputerze, który nie zawsze jest dostępny. Prosimy o cierpliwość, gdy coś trwa dłużej niż powinno. Nowi użytkownicy mogą się zapisać bez podawania nazwiska.
Wczoraj ulepszyliśmy wyszukiwanie i naprawiliśmy wiele błędów. Jest też lista wszystkich plików, które zostały przesłane w ostatnich tygodniach. Dobrze widzieć, że tak wielu ludzi bierze udział i dzieli się wiedzą.""",
    "sv": """På den här sidan hittar du nyheter, guider och ett arkiv med äldre inlägg. Om du vill fråga något, skriv bara ett kort meddelande till dem som sköter sidan; vi svarar oftast inom två dagar.
Tjänsten är gratis och körs på en liten maskin som inte alltid går att nå. Ha tålamod när något tar längre tid än det borde. Nya användare kan anmäla sig utan att ange sitt namn.
Igår gjorde vi sökningen bättre och rättade många fel. Det finns också en översikt över alla filer som har laddats upp under de senaste veckorna. Det är roligt att se att så många människor deltar och delar med sig av vad de kan.""",
    "ru": """На этой странице вы найдёте новости, руководства и архив старых записей. Если вы хотите что-то спросить, просто напишите короткое сообщение людям, которые следят за сайтом; обычно мы отвечаем в течение двух дней.
Служба бесплатна и работает на небольшой машине, которая не всегда доступна. Пожалуйста, будьте терпеливы, когда что-то занимает больше времени. Новые пользователи могут записаться, не называя своего имени.
Вчера мы улучшили поиск и исправили много ошибок. Также есть список всех файлов, которые были загружены за последние недели. Хорошо видеть, что так много людей участвует и делится тем, что знает. Для больших вопросов беседа открыта каждый вечер.""",
    "uk": """На цій сторінці ви знайдете новини, поради та архів старих записів. Якщо ви хочете щось запитати, просто напишіть коротке повідомлення людям, які доглядають за сайтом; зазвичай ми відповідаємо протягом двох днів.
Служба безкоштовна і працює на невеликій машині, яка не завжди доступна. Будь ласка, майте терпіння, коли щось триває довше. Нові користувачі можуть записатися, не називаючи свого імені.
Учора ми покращили пошук і виправили багато помилок. Також є перелік усіх файлів, які були завантажені за останні тижні. Добре бачити, що так багато людей бере участь і ділиться знаннями.""",
    "ja": """このページでは、お知らせや使い方の案内、古い記事の保管庫を見ることができます。何か聞きたいことがあれば、サイトを管理している人に短いメッセージを書いてください。たいてい二日以内に返事をします。
サービスは無料で、小さな機械の上で動いているので、いつもつながるとは限りません。時間がかかるときは、どうかお待ちください。新しい利用者は、名前を出さずに登録できます。
昨日は検索をよくして、たくさんの間違いを直しました。また、ここ数週間に送られたすべてのファイルの一覧もあります。多くの人が参加して、知っていることを分け合っているのはとてもよいことです。""",
    "zh": """在这个页面上，您可以找到新闻、使用说明和旧文章的存档。如果您想问问题，请给管理网站的人写一条简短的消息，我们一般会在两天之内回答。
这项服务是免费的，它在一台小机器上运行，所以不是总能连接上。如果需要更长的时间，请耐心等待。新用户可以不说出自己的名字就注册。
昨天我们改进了搜索，并且改正了很多错误。现在还有一个列表，包括最近几个星期上传的所有文件。看到这么多人参加并且和大家分享他们知道的东西，我们很高兴。每天晚上都可以来这里聊天，欢迎大家。""",
    "ko": """이 페이지에서는 소식과 안내, 그리고 오래된 글의 보관소를 볼 수 있습니다. 묻고 싶은 것이 있으면 사이트를 돌보는 사람들에게 짧은 글을 남겨 주세요. 보통 이틀 안에 대답합니다.
이 서비스는 무료이며 작은 기계에서 돌아가기 때문에 언제나 연결되는 것은 아닙니다. 시간이 더 걸릴 때에는 조금 기다려 주세요. 새로운 사용자는 이름을 밝히지 않고 가입할 수 있습니다.
어제는 검색을 더 좋게 만들고 많은 잘못을 고쳤습니다. 지난 몇 주 동안 올라온 모든 파일의 목록도 있습니다. 많은 사람이 함께하며 아는 것을 나누는 것은 좋은 일입니다.""",
}
