"""The small labelled table from which the page models are trained: single lines with their kind.

Kinds of furniture: menu, trail, tool, notice, advert, footer, teaser_head. Kinds of the body:
heading, item, sentence, title. ``error``, ``script`` and ``filler`` stand where a body should be.
``W`` and ``V`` stand for names, ``9`` for numbers.
"""

from __future__ import annotations

LABELLED_LINES: dict[str, tuple[str, ...]] = {
    "menu": (
        "Αρχική", "Δράσεις", "Νέα", "Έντυπα", "Εκδηλώσεις", "Διαύγεια πράξεων", "Ανοιχτοί κύκλοι", "Συχνές απορίες", "Σχετικά με εμάς", "Χάρτης ιστότοπου", "Επικοινωνήστε", "Είσοδος",
        "Home", "Actions", "News", "Forms", "Meetings", "Open rounds", "Questions", "About us", "Site map", "Get in touch", "Sign in", "Careers",
        "Startseite", "Förderungen", "Aktuelles", "Formulare", "Termine", "Übersicht", "Fragen", "Über uns", "Kontakt aufnehmen", "Anmelden",
        "Ελληνικά | English", "Deutsch | English", "English | Ελληνικά",
    ),
    "trail": ("Αρχική » Δράσεις > Πρόγραμμα W", "Home / Actions » W Warm Homes", "Startseite > Förderungen » Förderlinie W"),
    "tool": (
        "Α- Α Α+", "A- A A+", "Αναζήτηση…", "Search…", "Suche…", "← Προηγούμενο  Επόμενο →", "← Previous  Next →", "← Zurück  Weiter →", "Επιστροφή στην κορυφή", "Back to top", "Nach oben",
        "Κοινοποίηση | Εκτύπωση | Αποστολή με email", "Share | Print | Send by mail", "Teilen | Drucken | Weiterleiten", "Ήταν χρήσιμη αυτή η σελίδα; Ναι / Όχι", "Was this page useful? Yes / No", "War diese Seite hilfreich? Ja / Nein",
        "Τελευταία ενημέρωση: 9/9/9", "Last updated: 9 May 9", "Stand der Seite: 9.9.9", "Επισκέπτες σήμερα: 9", "Visitors today: 9", "Besucher heute: 9",
    ),
    "notice": (
        "Η συνέχιση της περιήγησης σημαίνει ότι δέχεστε τα cookies μας.", "By browsing on you accept our cookies.", "Mit der Nutzung stimmen Sie unseren Cookies zu.",
        "Για την ομαλή λειτουργία της σελίδας αποθηκεύουμε μικρά αρχεία στη συσκευή σας. Μάθετε περισσότερα", "We keep small files on your device so that this site works. Read more", "Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu",
        "Επιλέξτε ποια cookies επιτρέπετε: απαραίτητα, στατιστικά, προβολής. [Αποδοχή] [Άρνηση]", "Choose what you allow: needed, statistics, display. [Accept] [Refuse]", "Wählen Sie, was Sie zulassen: nötig, Statistik, Anzeige. [Annehmen] [Ablehnen]",
        "Η ιδιωτικότητά σας μετράει. Εμείς και 9 συνεργάτες κρατάμε στοιχεία περιήγησης για 9 μήνες, ώστε να μετράμε την απήχηση των σελίδων και να βελτιώνουμε το περιεχόμενο που βλέπετε. Ρυθμίσεις",
        "Your privacy counts. We and 9 partners keep browsing details for 9 months to measure how pages are used and to improve the material you see. Settings",
        "Ihre Daten sind uns wichtig. Wir und 9 Partner bewahren Angaben 9 Monate auf, um die Nutzung der Seiten zu messen. Einstellungen",
        "Για πλήρη προβολή του χάρτη ενεργοποιήστε τη JavaScript.", "Enable JavaScript to see the interactive map.", "Für die Karte bitte JavaScript einschalten.",
        "Γραφτείτε στο ενημερωτικό δελτίο: το email σας [Εγγραφή]", "Join our newsletter: your email [Sign up]", "Rundbrief bestellen: Ihre Adresse [Absenden]",
    ),
    "advert": ("Διαφήμιση: ηλιακά πάνελ από 9 €", "Advert: solar panels from 9 EUR", "Anzeige: Solarmodule ab 9 €"),
    "footer": (
        "© 9 Περιφερειακό Ταμείο W – Με επιφύλαξη κάθε δικαιώματος", "© 9 W Regional Fund. All rights kept", "© 9 Förderbank W – Alle Rechte vorbehalten",
        "Όροι χρήσης · Απόρρητο · Προσβασιμότητα", "Terms of use · Privacy · Accessibility", "Nutzung · Datenschutz · Barrierefreiheit",
        "Ακολουθήστε μας στα κοινωνικά δίκτυα", "Follow us on social networks", "Folgen Sie uns in den sozialen Netzen",
        "Κατασκευή ιστοσελίδας: W Ψηφιακή", "Site made by W Digital", "Webseite von W Digital", "Γραφεία: οδός W 9, V", "Office: 9 W Street, V", "Büro: Wweg 9, V",
        "Τηλεφωνικό κέντρο: +9 9 9 9, καθημερινά 9 με 9", "Switchboard: +9 9 9 9, weekdays 9 to 9", "Zentrale: +9 9 9 9, werktags 9 bis 9 Uhr",
    ),
    "teaser_head": ("Δημοφιλή αυτή την εβδομάδα", "Σχετικά θέματα", "Διαβάστε ακόμη", "Popular this week", "Related items", "Read next", "Lesen Sie auch", "Verwandte Themen", "Beliebt in dieser Woche"),
    "heading": (
        "Τι χρηματοδοτείται", "Ποσά και διάρκεια", "Ποιοι συμμετέχουν", "Βήματα υποβολής", "Χρήσιμες ημερομηνίες", "Έλεγχος και πληρωμή",
        "What is paid for", "Sums and terms", "Who takes part", "Steps to apply", "Dates to note", "Checks and payment",
        "Was bezahlt wird", "Beträge und Laufzeit", "Wer mitmacht", "Schritte zum Antrag", "Prüfung und Zahlung", "Termine",
    ),
    "item": (
        "Μόνωση δώματος έως 9 τ.μ.", "Νέα παράθυρα (9 τεμάχια)", "Φωτισμός κλιμακοστασίου, έως 9 €", "Λέβητας 9 kW με αισθητήρα", "Αποθήκη ενέργειας 9 kWh", "Μελέτη από την Τράπεζα W", "Μελέτη από την Περιφερειακό Ταμείο W", "Σκίαστρα όψης στο W",
        "Roof insulation up to 9 m²", "New windows (9 pieces)", "Stairwell lighting, up to 9 EUR", "Boiler of 9 kW with sensor", "Storage of 9 kWh", "Study by the W Savings Bank", "Study by the W Regional Fund", "Façade shading in W",
        "Dachdämmung bis 9 m²", "Neue Fenster (9 Stück)", "Speicher mit 9 kWh", "Studie durch das Förderbank W",
    ),
    "title": (
        "Πρόγραμμα W", "Νέα στέγη W", "W: φως και μόνωση", "W για θερμές κατοικίες", "W – Κτίρια χαμηλής κατανάλωσης", "Κύκλος 9 «W»", "Δράση W 9", "Σχέδιο W V",
        "W Warm Homes", "W Retrofit Scheme 9", "W – Low Energy Buildings", "W Roof and Window Loan", "Round 9 of W", "Action W", "V Insulation Plan W", "Förderlinie W", "Programm W 9", "W – Sanieren in V",
    ),
    "sentence": (
        "Το επιτόκιο ορίζεται σε 9 % και μένει σταθερό για 9 χρόνια.", "Κάθε νοικοκυριό μπορεί να λάβει έως 9 € για εργασίες που ολοκληρώνονται μέχρι 9/9/9.", "Ο φάκελος κατατίθεται στο Ταμείο W και εξετάζεται μέσα σε 9 εργάσιμες.",
        "Στην πρώτη φάση μπήκαν 9 κτίρια, ενώ 9 περιμένουν συμπληρωματικά χαρτιά.", "Η πλατφόρμα θέλει ενεργή JavaScript, όμως τα έντυπα του κύκλου 9 δίνονται και σε χαρτί.", "Η απόφαση με αριθμό 9/9 ορίζει ποσό 9 € για το W.",
        "Η δράση «W» στηρίζει τη μόνωση και τον εξοπλισμό σπιτιών στην περιοχή V.", "Απορίες για τον κύκλο 9 λύνει το γραφείο W στο +9 9 9 9.", "Στο W λειτουργεί γραφείο ενημέρωσης που δέχεται κοινό μετά από ραντεβού από τις 9.9.9.",
        "Οι όροι τροποποιήθηκαν στις 9 Μαΐου 9 ώστε να χωρούν και μισθωμένα ακίνητα έως 9 τ.μ. (βλ. παράγραφο 9).", "Υπενθύμιση: Τρεις προσφορές αρκούν για δαπάνη ως 9 €, διαφορετικά ζητούνται πέντε.",
        "Δεν χρειάζεται νέα μελέτη όταν η παλιά έγινε μετά τις 9/9/9.", "Η αντλία θερμότητας πρέπει να έχει ισχύ τουλάχιστον 9 kW και εγγύηση 9 ετών.", "Αν κατά την υποβολή εμφανιστεί σφάλμα 9, κρατήστε το στιγμιότυπο και στείλτε το στο Ταμείο W.", "Όσοι πήραν ενίσχυση μετά τις 9/9/9 αποκλείονται από τον νέο κύκλο.",
        "Για πολυκατοικίες με περισσότερα από 9 διαμερίσματα απαιτείται απόφαση της συνέλευσης των ενοίκων.", "Ονομάστε το αρχείο ως [ΑΦΜ]_9.pdf και ανεβάστε το πριν από τις 9/9/9.", "Οι κλάσεις {Α, Β, Γ} ισχύουν για κτίρια έως 9 τ.μ. [9].",
        "The rate is 9% and stays fixed for 9 years.", "No new survey is needed when the old one was made after 9/9/9.", "Three quotes suffice for costs up to 9 EUR; above that, five are asked for.", "Decision 9/9 sets 9 EUR for W.", "A home may receive up to 9 EUR for works that are finished by 9/9/9.", "Files go to the W Fund and are examined within 9 working days.", "If error 9 appears while sending, keep a screenshot and mail it to the W Savings Bank.",
        "The platform needs JavaScript, yet forms of round 9 are also handed out on paper.", "Name the file [meter]_9.pdf and upload it before 9/9/9.", "Queries on round 9 go to the W desk, +9 9 9 9.", "The W action helps households in V to insulate walls and replace old boilers.",
        "An advice desk in W receives visitors by appointment from 9 October 9.", "Note: Terms were amended on 9.9.9 to admit let properties of up to 9 m² and not sooner than 9 days.",
        "Erscheint beim Senden Fehler 9, bitte Bild an das Amt W schicken.", "Beschluss 9/9 nennt 9 € für W.", "Für Kosten über 9 € sind fünf Angebote nötig.", "Die Plattform braucht JavaScript, doch Formulare der Runde 9 gibt es auch auf Papier.",
        "Der Zinssatz beträgt 9 % und bleibt 9 Jahre gleich.", "Pro Wohnung sind bis zu 9 € möglich, wenn die Arbeiten bis 9/9/9 fertig sind.", "Der Antrag geht an das Amt für Gebäudesanierung W und wird in 9 Werktagen geprüft.", "Fragen zu Runde 9 beantwortet das Büro W, +9 9 9 9.",
    ),
    "error": (
        "Error 9: the address you asked for is gone.", "Gateway 9 upstream timed out", "Service unavailable (9). Retry in 9 seconds.", "Something went wrong on our side. Ticket 9", "Access denied. You do not have permission to open this path. Ref 9",
        "Your session has run out. Sign in again.", "Too many requests from your device.", "We are down for maintenance until 9/9/9.", "This domain is parked. Buy it today.", "Oops, nothing here!",
        "java.lang.IllegalStateException: view 9 not resolved", "Fatal: could not open database link in /srv/web/lib_9.php on row 9", "Σφάλμα εφαρμογής: αδυναμία σύνδεσης με τη βάση (9)", "Ο διακομιστής δεν αποκρίνεται – 9",
        "Η διεύθυνση που ζητήσατε δεν υπάρχει πια (κωδικός 9).", "Ουπς! Δεν βρήκαμε αυτό που ψάχνετε", "Κάτι πήγε στραβά. Δοκιμάστε πάλι σε λίγα λεπτά. Αναφορά 9", "Δεν έχετε δικαίωμα πρόσβασης σε αυτή τη διαδρομή.", "Η συνεδρία σας έληξε. Συνδεθείτε ξανά.",
        "Πάρα πολλές κλήσεις από τη συσκευή σας. Περιμένετε 9 δευτερόλεπτα.", "Ο ιστότοπος βρίσκεται σε εργασίες συντήρησης έως τις 9/9/9.", "Kein Zugriff auf diesen Pfad.", "Da ging etwas schief. Vorgang 9", "Wartung bis 9.9.9, bitte später wiederkommen.",
        "Fehler 9: Diese Adresse gibt es nicht mehr.", "Die Seite wurde nicht gefunden.", "Der Server antwortet nicht.", "Page not found", "Internal server error",
    ),
    "script": (
        "You need to turn on JavaScript to run this app.", "Scripts are blocked by your browser. Allow them and reload.", "Loading… If nothing shows, let this page run code.", "Checking your connection before you go on… scripts and cookies required. Ray 9",
        "This browser is not supported. Update it or switch scripting on.", "Η εφαρμογή χρειάζεται JavaScript για να ανοίξει.", "Ο φυλλομετρητής σας έχει απενεργοποιημένα τα σενάρια. Ενεργοποιήστε τα και φορτώστε ξανά.",
        "Ελέγχουμε τη σύνδεσή σας πριν συνεχίσετε… Απαιτούνται σενάρια και cookies. Κωδικός 9", "Φόρτωση… Αν δεν βλέπετε τίποτα, επιτρέψτε την εκτέλεση κώδικα στη σελίδα.", "Diese Anwendung läuft nur mit JavaScript.", "Skripte sind in Ihrem Browser gesperrt. Bitte zulassen und neu laden.",
    ),
    "filler": (
        "Lorem ipsum dolor sit amet consectetur adipis elit sed do tempor incid labore magna aliqua enim minim veniam quis nostru exerci ullam laboris nisi aliquip commod", "Duis aute irure repre volupt velit esse cillum fugiat nulla pariat except sint occaec cupid culpa officia deser mollit anim",
        "Bla asdf qwer aaa xxx jkl test asdf bla qwer δοκιμή τεστ", "Δείγμα λέξη τίτλος κείμενο γραμμή παράγραφος δοκιμής", "Sample copy goes in this box. Sample copy goes in this box.", "Δοκιμαστική παράγραφος προς αντικατάσταση. Δοκιμαστική παράγραφος προς αντικατάσταση.",
        "Εδώ θα μπει το κείμενο. Εδώ θα μπει το κείμενο.", "Platzhaltertext für den Entwurf. Platzhaltertext für den Entwurf.", "Heading", "Τίτλος ενότητας", "Überschrift", "Text text text word word line line paragraph sample title",
    ),
}

#: Words by which an organisation at the end of a window title is known.
ORGANISATION_WORDS = frozenset("Ταμείο Τράπεζα Εταιρεία Διεύθυνση Οργανισμός Γραφείο Δήμος Υπουργείο Fund Bank Directorate Company Office Agency Ministry Council Amt Förderbank Energieverein Ministerium Banque Agence Banco Agência".split())

FURNITURE = frozenset({"menu", "trail", "tool", "notice", "advert", "footer", "teaser_head"})
RESIDUE = frozenset({"error", "script", "filler"})
