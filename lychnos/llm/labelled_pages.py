"""A labelled sample of pages, from which the tree over blocks is trained: a site, then its blocks, ``+`` for the main body and ``-`` for furniture."""

LABELLED_PAGES = """
solereo-000
- Σολομία – Κτίρια χαμηλής κατανάλωσης - Συνεταιριστικό Ταμείο Κατωλίμνη
- Δράσεις
- Νέα
- Σχετικά με εμάς
- Εκδηλώσεις
- Χάρτης ιστότοπου
- Ανοιχτοί κύκλοι
- Συχνές απορίες
- Διαύγεια πράξεων
- Έντυπα
- Κοινοποίηση | Εκτύπωση | Αποστολή με email
- Ελληνικά | English
+ Σολομία – Κτίρια χαμηλής κατανάλωσης
+ Έλεγχος και πληρωμή
- ← Προηγούμενο  Επόμενο →
+ Οι όροι τροποποιήθηκαν στις 05/04/2028 ώστε να χωρούν και μισθωμένα ακίνητα έως 113 τ.μ. Απορίες για τον κύκλο 26 λύνει το γραφείο Μακρυκαμπος στο +30 200 555 1024. Το συνολικό ποσό που διατίθεται στον κύκλο 84 είναι 847 εκατ. €, με επιπλέον 22.100 € για το Μακρυποτάμι (βλ. παράγραφο 23).
+ Σε κάθε περίπτωση: Η δράση «Πυραρίς» στηρίζει τη μόνωση και τον εξοπλισμό σπιτιών στην περιοχή Παλαιοχώρι (βλ. παράγραφο 2). Το έντυπο 27 κατεβαίνει από το https://norop17.example/entypa/704 και επιστρέφεται στο grafeio@bereth76.example.
- Η συνέχιση της περιήγησης σημαίνει ότι δέχεστε τα cookies μας.
- Δημοφιλή αυτή την εβδομάδα
- Σχέδιο Ηλιινίς Λευκοδάσος
- Ο συνδυασμός μόνωσης και ηλιακού θερμαντήρα δίνει δικαίωμα σε προσαύξηση…
- Πρόγραμμα Λαμινίς
- Γραφεία: οδός Κοραρις 22, Παλαιοχώρι
- Τηλεφωνικό κέντρο: +30 200 555 4159, καθημερινά 9 με 3

corethor-100
- Αρχική / Δράσεις » Σχέδιο Νεφομων Νεοχώρι
- Διαφήμιση: ηλιακά πάνελ από 2.400 €
+ Σχέδιο Νεφομων Νεοχώρι
+ Χρήσιμες ημερομηνίες
+ Κοινόχρηστοι χώροι μετρούν για το 67,0 % της επιφάνειας. Σημείωση: Κάθε νοικοκυριό μπορεί να λάβει έως 81.800 € για εργασίες που ολοκληρώνονται μέχρι 2027-07-27, αρχής γενομένης στις 2027-12-16. Τα τιμολόγια ανεβαίνουν στην πλατφόρμα το αργότερο 76 μέρες μετά την πληρωμή (βλ. παράγραφο 34). Τα σχολεία και τα ιατρεία του Αγριοχώρι εντάσσονται σε χωριστό πίνακα με προϋπολογισμό 547 εκατ. €, αρχής γενομένης στις 17 Αυγούστου 2027. Σε παραδοσιακούς οικισμούς, όπως το Λευκοράχη, ζητείται έγκριση όψεων πριν από τις 2022-05-16.
- Για την ομαλή λειτουργία της σελίδας αποθηκεύουμε μικρά αρχεία στη συσκευή σας. Μάθετε περισσότερα
- Τελευταία ενημέρωση: 22 Φεβρουαρίου 2024
- Αναζήτηση…
- Δημοφιλή αυτή την εβδομάδα
- Τεραρώ – Κτίρια χαμηλής κατανάλωσης
- Πρόγραμμα Ηλιανίς
- Οι αιτούντες που ζουν σε σπίτι μικρότερο από 284 τ.μ.…
- Αρχική
- Διαύγεια πράξεων
- Είσοδος
- Νέα
- Έντυπα
- Χάρτης ιστότοπου
- Επικοινωνήστε
- Σχετικά με εμάς
- © 2025 Γραφείο Ενεργειακών Έργων Δρυιδις – Με επιφύλαξη κάθε δικαιώματος
- Ακολουθήστε μας στα κοινωνικά δίκτυα
- Κατασκευή ιστοσελίδας: Μελεθας Ψηφιακή
- Τηλεφωνικό κέντρο: +30 200 555 5405, καθημερινά 9 με 3
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- Επισκέπτες σήμερα: 7928
- Γραφεία: οδός Σολακας 50, Μεσοβούνι

coridene-179
- Βερακίς για θερμές κατοικίες | Περιφερειακό Ταμείο Μεσολίμνη
- Διαύγεια πράξεων
- Είσοδος
- Έντυπα
- Χάρτης ιστότοπου
- Κοινοποίηση | Εκτύπωση | Αποστολή με email
- Α- Α Α+
+ Βερακίς για θερμές κατοικίες
+ Κάθε νοικοκυριό μπορεί να λάβει έως 15.500 € για εργασίες που ολοκληρώνονται μέχρι 19 Νοεμβρίου 2020.
+ * Μελέτη από την Τράπεζα Νεφακας
- ← Προηγούμενο  Επόμενο →
- Διαφήμιση: ηλιακά πάνελ από 87.600 €
+ * Αποθήκη ενέργειας 87 kWh
+ * Αποθήκη ενέργειας 16 kWh
+ * Φωτισμός κλιμακοστασίου, έως 41.900 €
+ * Μελέτη από την Αναπτυξιακή Εταιρεία Νεφινας
- Ακολουθήστε μας στα κοινωνικά δίκτυα
- Γραφεία: οδός Τερεθώ 34, Μεσολόφος

wileria-171
- Actions
- Site map
- Forms
- Sign in
- Home > Actions » Corinis Roof and Window
- Was this page useful? Yes / No
+ Corinis Roof and Window Loan
+ In short: An advice desk in Longridge receives visitors by appointment from 24 September 2019, which is looked at every 30 months.
+ Checks and payment
+ - Façade shading in Marlhaven
- Back to top
- Popular this week
- Norulene – Low Energy Buildings
- Solomeo – Low Energy Buildings
+ - Façade shading in Stoneridge
+ - Study by the Longford Housing Directorate
- Join our newsletter: your email [Sign up]
- © 2025 Longhaven Cooperative Fund. All rights kept
- Terms of use · Privacy · Accessibility
- Switchboard: +30 200 555 2962, weekdays 9 to 3
- Site made by Pelulis Digital
- Visitors today: 6551
- Office: 39 Wilopor Street, Birchwick
- Follow us on social networks

lumidum-010
- Join our newsletter: your email [Sign up]
+ Round 13 of Venanis
+ Dates to note
+ No new survey is needed when the old one was made after 28 August 2023. More than 558 forms were lodged in the first week, mainly from Lowerfield and Uppercombe. A supplier can be replaced once if the new quote isn’t above 56,900 EUR. Note: The advance stays below 74.2% and needs a guarantee from the Pelidum Savings Bank, starting on 25 March 2025. Note: Three quotes suffice for costs up to 12,900 EUR; above that, five are asked for.
+ The surveyor writes one certificate before and one after the works, at a cost of €797, starting on 28/10/2026. An advice desk in Lowermere receives visitors by appointment from 4 October 2023. Queries on round 69 go to the Stoneridge desk, +30 200 555 9958. Insulation combined with a solar heater earns a top-up of 40,000 EUR.
+ Steps to apply
+ * Storage of 55 kWh
+ * Façade shading in Greyfield
+ * Boiler of 66 kW with sensor
+ * Façade shading in Birchmoor
+ * Façade shading in Fernwick
+ Dates to note
- Your privacy counts. We and 53 partners keep browsing details for 9 months to measure how pages are used and to improve the material you see. Settings
+ Average savings measured in Whitestead reached 4.2% over 83 months (see paragraph 87).
+ The note is valid for 63 months and is renewed through https://merac47.example/doc/491.
+ Windows with a coefficient below 1.38 attract 20,000 EUR per dwelling.
- Last updated: 20/04/2025
- Site map
- Open rounds
- Questions
- Get in touch
- Sign in
- Actions
- Switchboard: +30 200 555 2982, weekdays 9 to 3
- Follow us on social networks
- Visitors today: 7646
- Office: 2 Alinas Street, Lowerridge
- Terms of use · Privacy · Accessibility
- Site made by Garomene Digital

fenomene-162
- Λαμερία για θερμές κατοικίες – Οργανισμός Κτιρίων Λαμεθας
- Ανοιχτοί κύκλοι
- Δράσεις
- Έντυπα
- Συχνές απορίες
+ Λαμερία για θερμές κατοικίες
+ Η αντλία θερμότητας πρέπει να έχει ισχύ τουλάχιστον 86 kW και εγγύηση 23 ετών.
+ Τι χρηματοδοτείται
+ Η προκαταβολή δεν ξεπερνά το 15,6 % και δίνεται με εγγυητική από την Περιφερειακό Ταμείο Νεολόφος.
+ Προσοχή – Ο εγκαταστάτης εγγράφεται στο μητρώο του Χρυσοχώρι και πληρώνει τέλος 20.800 €, με εξαίρεση το Μακρυράχη.
+ Σκίαστρα όψης στο Χρυσοράχη
+ Σκίαστρα όψης στο Νεοράχη
+ Η Γενική Διεύθυνση Κατοικίας Πετροχώρι καλύπτει το 41,6 % της δαπάνης και το υπόλοιπο βαρύνει τον ιδιοκτήτη.
+ Το συνολικό ποσό που διατίθεται στον κύκλο 15 είναι 3 εκατ. €, με επιπλέον 40.800 € για το Χρυσοράχη.
- Επιλέξτε ποια cookies επιτρέπετε: απαραίτητα, στατιστικά, προβολής. [Αποδοχή] [Άρνηση]
- Κοινοποίηση | Εκτύπωση | Αποστολή με email
- Διαβάστε ακόμη
- Πρόγραμμα Λαμοπία
- Νέα στέγη Βερακία
- Αλακων – Κτίρια χαμηλής κατανάλωσης
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- Επισκέπτες σήμερα: 1207
- Κατασκευή ιστοσελίδας: Θεροπία Ψηφιακή

holanene-002
- Χάρτης ιστότοπου  Νέα  Δράσεις  Σχετικά με εμάς
- Αρχική > Δράσεις » Πρόγραμμα Φανερας
+ Πρόγραμμα Φανερας
+ Ο μηχανικός συντάσσει δύο πιστοποιητικά, ένα πριν και ένα μετά τις εργασίες, με κόστος έως 89.100 €.
+ Έλεγχος και πληρωμή
+ Νέα παράθυρα (75 τεμάχια)
+ Φωτισμός κλιμακοστασίου, έως 50.400 €
+ Λέβητας 59 kW με αισθητήρα
- Α- Α Α+
+ Ο συνδυασμός μόνωσης και ηλιακού θερμαντήρα δίνει δικαίωμα σε προσαύξηση 87.800 €. Το έντυπο 10 κατεβαίνει από το https://wilom78.example/forms/664 και επιστρέφεται στο desk@merul12.example. Ο συνδυασμός μόνωσης και ηλιακού θερμαντήρα δίνει δικαίωμα σε προσαύξηση 87.900 €. Αλλαγή προμηθευτή επιτρέπεται μία φορά, εφόσον η νέα προσφορά δεν ξεπερνά τα 6.700 €. Δεν χρειάζεται νέα μελέτη όταν η παλιά έγινε μετά τις 14 Απριλίου 2025.
- Ακολουθήστε μας στα κοινωνικά δίκτυα
- Τηλεφωνικό κέντρο: +30 200 555 9324, καθημερινά 9 με 3
- Γραφεία: οδός Νεφαρων 78, Λευκοχώρι

bererum-012
- Careers  Get in touch  Site map  Forms  Sign in  Open rounds
- Join our newsletter: your email [Sign up]
+ Action Dalaceo
+ When works run past 15 March 2026, the sum is cut by 72.2%. Take care – Applicants living in less than 643 m² are given 29 additional points. A supplier can be replaced once if the new quote isn’t above 50,300 EUR. Blocks with more than 88 flats need a decision of the owners’ meeting – signed by all. More than 70 forms were lodged in the first week, mainly from Whiteridge and Greyford.
+ What is paid for
+ Note: A heat pump must deliver at least 42 kW and carry a warranty of 11 years (see paragraph 44). The advance stays below 69.8% and needs a guarantee from the Stonehaven Housing Directorate.
+ The rate is 8.2% and stays fixed for 25 years. Insulation combined with a solar heater earns a top-up of 4,300 EUR. No new survey is needed when the old one was made after 25 November 2023 and not sooner than 58 days. The surveyor writes one certificate before and one after the works, at a cost of €322.
+ Who takes part
+ • Study by the Stonemoor Housing Directorate
- Your privacy counts. We and 75 partners keep browsing details for 5 months to measure how pages are used and to improve the material you see. Settings
- A- A A+
- Related items
- Marlhaven Insulation Plan Toromon
- Action Holidon
+ • New windows (28 pieces)
+ • Study by the Dalinor Regional Fund
- Visitors today: 1209
- Site made by Fenethia Digital
- Switchboard: +30 200 555 1752, weekdays 9 to 3
- Follow us on social networks
- © 2025 Dalacis Regional Fund. All rights kept
- Office: 58 Pelethas Street, Marlford

torethor-090
- Ηλιεθία – Κτίρια χαμηλής κατανάλωσης - Συνεταιριστικό Ταμείο Μακρυπηγάδι
- Επιστροφή στην κορυφή
+ Ηλιεθία – Κτίρια χαμηλής κατανάλωσης
+ Ποσά και διάρκεια
+ Προσοχή – Τα τιμολόγια ανεβαίνουν στην πλατφόρμα το αργότερο 18 μέρες μετά την πληρωμή.
+ Οι αιτούντες που ζουν σε σπίτι μικρότερο από 264 τ.μ. βαθμολογούνται με 63 επιπλέον μονάδες.
+ Κάθε νοικοκυριό μπορεί να λάβει έως 4.600 € για εργασίες που ολοκληρώνονται μέχρι 4.9.2025.
+ Έλεγχος και πληρωμή
+ Τα σχολεία και τα ιατρεία του Ξεροποτάμι εντάσσονται σε χωριστό πίνακα με προϋπολογισμό 246 εκατ. €. Οι όροι τροποποιήθηκαν στις 20/11/2027 ώστε να χωρούν και μισθωμένα ακίνητα έως 126 τ.μ. Στο Κατωπηγάδι λειτουργεί γραφείο ενημέρωσης που δέχεται κοινό μετά από ραντεβού από τις 2021-03-10.
+ Τι χρηματοδοτείται
- Επιλέξτε ποια cookies επιτρέπετε: απαραίτητα, στατιστικά, προβολής. [Αποδοχή] [Άρνηση]
- Κοινοποίηση | Εκτύπωση | Αποστολή με email
+ Ο μηχανικός συντάσσει δύο πιστοποιητικά, ένα πριν και ένα μετά τις εργασίες, με κόστος έως 9.000 €. Σημείωση: Στην πρώτη φάση μπήκαν 587 κτίρια, ενώ 68 περιμένουν συμπληρωματικά χαρτιά, με εξαίρεση το Αγριοχώρι. Τα τιμολόγια ανεβαίνουν στην πλατφόρμα το αργότερο 76 μέρες μετά την πληρωμή. Η Αναπτυξιακή Εταιρεία Δρυεθειο καλύπτει το 47,8 % της δαπάνης και το υπόλοιπο βαρύνει τον ιδιοκτήτη.
- Για πλήρη προβολή του χάρτη ενεργοποιήστε τη JavaScript.
- Διαβάστε ακόμη
- Δράση Ηλιινας 82
- Κάθε νοικοκυριό μπορεί να λάβει έως 60.100 € για εργασίες που ολοκληρώνονται μέχρι…
- Πρόγραμμα Θερυλις
- Είσοδος
- Έντυπα
- Συχνές απορίες
- Χάρτης ιστότοπου
- Επικοινωνήστε
- Επισκέπτες σήμερα: 1399
- Τηλεφωνικό κέντρο: +30 200 555 1854, καθημερινά 9 με 3
- Γραφεία: οδός Θερεθις 8, Παλαιοκαμπος
- Κατασκευή ιστοσελίδας: Λαμιδας Ψηφιακή
- Ακολουθήστε μας στα κοινωνικά δίκτυα
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- © 2025 Συνεταιριστικό Ταμείο Μακρυπηγάδι – Με επιφύλαξη κάθε δικαιώματος

bereria-035
- Formulare | Förderungen | Übersicht | Startseite | Aktuelles | Kontakt aufnehmen | Anmelden
- Startseite > Förderungen » Förderlinie Pelacis
- Anzeige: Solarmodule ab 46.400 €
+ Förderlinie Pelacis
+ Erscheint beim Senden Fehler 410, bitte Bild an das Energieverein Oberköhlen schicken.
+ Schritte zum Antrag
+ Kurz gesagt: Wohnungen unter 331 m² erhalten 88 zusätzliche Punkte, frühestens ab dem 9.11.2020. Kurz gesagt: Fragen zu Runde 72 beantwortet das Büro Ferncombe, +30 200 555 9527, außer in Grünwerd.
+ Wohnungen unter 777 m² erhalten 19 zusätzliche Punkte. Gemeinschaftsräume zählen zu 34,4 % der Fläche.
- Nach oben
- Lesen Sie auch
- Programm Pelaceo 22
- Fragen zu Runde 59 beantwortet das Büro…
- Holopene – Sanieren in Mühlsberg
- Der Zinssatz beträgt 27,2 % und…
+ Rechnungen sind spätestens 17 Tage nach Zahlung hochzuladen.
+ Der Antrag geht an das Amt für Gebäudesanierung Bärenloh und wird in 80 Werktagen geprüft.
+ Der Zinssatz beträgt 24,4 % und bleibt 3 Jahre gleich.
- Deutsch | English
- Besucher heute: 4457
- Zentrale: +30 200 555 9076, werktags 9 bis 15 Uhr
- Büro: Corarisweg 71, Whitehaven
- Nutzung · Datenschutz · Barrierefreiheit
- © 2025 Amt für Gebäudesanierung Bärenloh – Alle Rechte vorbehalten

coracor-015
- Κύκλος 15 «Βεριδειο» - Αναπτυξιακή Εταιρεία Λαμεθων
- Είσοδος  Ανοιχτοί κύκλοι  Αρχική  Διαύγεια πράξεων  Συχνές απορίες  Επικοινωνήστε  Νέα  Σχετικά με εμάς
- ← Προηγούμενο  Επόμενο →
+ Κύκλος 15 «Βεριδειο»
+ Χρήσιμες ημερομηνίες
- Α- Α Α+
- Σχετικά θέματα
- Πρόγραμμα Πυρακός
- Δρυινώ: φως και μόνωση
- Το έντυπο 54 κατεβαίνει από το https://norin13.example/entypa/432 και…
- Δράση Κορυλία 9
- Φανοπός – Κτίρια χαμηλής κατανάλωσης
- Τρεις προσφορές αρκούν για δαπάνη ως 71.400 €,…
+ Οι αιτούντες που ζουν σε σπίτι μικρότερο από 832 τ.μ. βαθμολογούνται με 7 επιπλέον μονάδες.
+ Χρήσιμες ημερομηνίες
+ Μελέτη από την Περιφερειακό Ταμείο Λευκοχώρι
+ Μελέτη από την Αναπτυξιακή Εταιρεία Τεριδός
+ Νέα παράθυρα (59 τεμάχια)
+ Λέβητας 41 kW με αισθητήρα
+ Ποσά και διάρκεια
+ Η Τράπεζα Φανανίς καλύπτει το 56,9 % της δαπάνης και το υπόλοιπο βαρύνει τον ιδιοκτήτη – το ίδιο ισχύει και για το Πετροδάσος. Ειδικότερα: Τρεις προσφορές αρκούν για δαπάνη ως 9.700 €, διαφορετικά ζητούνται πέντε. Το έντυπο 29 κατεβαίνει από το https://coreth84.example/entypa/816 και επιστρέφεται στο grafeio@norid64.example. Σε κάθε περίπτωση: Ο συνδυασμός μόνωσης και ηλιακού θερμαντήρα δίνει δικαίωμα σε προσαύξηση 17.900 € (βλ. παράγραφο 74). Η αντλία θερμότητας πρέπει να έχει ισχύ τουλάχιστον 38 kW και εγγύηση 7 ετών.
- Για την ομαλή λειτουργία της σελίδας αποθηκεύουμε μικρά αρχεία στη συσκευή σας. Μάθετε περισσότερα
- Επισκέπτες σήμερα: 4942
- Ακολουθήστε μας στα κοινωνικά δίκτυα
- © 2025 Αναπτυξιακή Εταιρεία Λαμεθων – Με επιφύλαξη κάθε δικαιώματος

wileris-008
- Αρχική > Δράσεις > Νέα στέγη Κορεθίς
- Α- Α Α+
- Διαφήμιση: ηλιακά πάνελ από 17.300 €
+ Νέα στέγη Κορεθίς
+ Ποσά και διάρκεια
+ Μελέτη από την Οργανισμός Κτιρίων Βερακων
+ Αποθήκη ενέργειας 81 kWh
+ Μελέτη από την Γραφείο Ενεργειακών Έργων Βερανία
+ Μόνωση δώματος έως 377 τ.μ.
- Η ιδιωτικότητά σας μετράει. Εμείς και 62 συνεργάτες κρατάμε στοιχεία περιήγησης για 27 μήνες, ώστε να μετράμε την απήχηση των σελίδων και να βελτιώνουμε το περιεχόμενο που βλέπετε. Ρυθμίσεις
- Ελληνικά | English
- Ήταν χρήσιμη αυτή η σελίδα; Ναι / Όχι
+ Η βεβαίωση ισχύει 70 μήνες και ανανεώνεται μέσω του https://norul10.example/entypa/342. Το συνολικό ποσό που διατίθεται στον κύκλο 24 είναι 104 εκατ. €, με επιπλέον 78.400 € για το Ξεροποτάμι.
- Επιστροφή στην κορυφή
- Χάρτης ιστότοπου
- Δράσεις
- Είσοδος
- Ανοιχτοί κύκλοι
- Επικοινωνήστε
- Κατασκευή ιστοσελίδας: Φανοπία Ψηφιακή
- Επισκέπτες σήμερα: 8054
- Γραφεία: οδός Καλαρων 63, Μακρυλίμνη
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- Τηλεφωνικό κέντρο: +30 200 555 9238, καθημερινά 9 με 3
- Ακολουθήστε μας στα κοινωνικά δίκτυα

coracon-097
- Χάρτης ιστότοπου  Εκδηλώσεις  Είσοδος  Έντυπα  Διαύγεια πράξεων  Νέα  Σχετικά με εμάς
- Αναζήτηση…
- Κοινοποίηση | Εκτύπωση | Αποστολή με email
+ Δράση Φανιδία 23
+ Η πλατφόρμα θέλει ενεργή JavaScript, όμως τα έντυπα του κύκλου 43 δίνονται και σε χαρτί.
+ Βήματα υποβολής
+ * Αποθήκη ενέργειας 32 kWh
- Η συνέχιση της περιήγησης σημαίνει ότι δέχεστε τα cookies μας.
- Τελευταία ενημέρωση: 2027-01-17
- Επιστροφή στην κορυφή
- Δημοφιλή αυτή την εβδομάδα
- Σχέδιο Λαμακία Μακρυνήσι
- Ο συνδυασμός μόνωσης και ηλιακού θερμαντήρα δίνει δικαίωμα σε προσαύξηση 65.200…
- Λαμερώ – Κτίρια χαμηλής κατανάλωσης
- Σημείωση: Το συνολικό ποσό που διατίθεται στον κύκλο 89 είναι 564 εκατ. €, με επιπλέον 63.400 €…
+ * Αποθήκη ενέργειας 8 kWh
+ * Αποθήκη ενέργειας 9 kWh
- © 2025 Γραφείο Ενεργειακών Έργων Φανακός – Με επιφύλαξη κάθε δικαιώματος
- Κατασκευή ιστοσελίδας: Ηλιινία Ψηφιακή
- Γραφεία: οδός Πυρερία 12, Αγριολόφος
- Τηλεφωνικό κέντρο: +30 200 555 1270, καθημερινά 9 με 3

alideo-003
- Questions
- Meetings
- Get in touch
- Actions
- Site map
- Home > Actions » Meropia Roof and Window
- Choose what you allow: needed, statistics, display. [Accept] [Refuse]
- Advert: solar panels from 600 EUR
- Search…
+ Meropia Roof and Window Loan
+ The rate is 64.0% and stays fixed for 27 years.
- Join our newsletter: your email [Sign up]
- Was this page useful? Yes / No
+ Anyone who drew support after 07/04/2023 is left out of the new round, save for Ferncombe.
+ Round 42 makes €747 million available, and a further 60,200 EUR is kept aside for Lowermere, save for Birchford.
- Popular this week
- Pelaron – Low Energy Buildings
- Action Venomis
- A home may receive up to 60,100 EUR for works that…
- Meridia Warm Homes
- Visitors today: 2676
- Terms of use · Privacy · Accessibility
- Site made by Venerene Digital
- © 2025 Garerum Energy Works Office. All rights kept
- Office: 78 Wilomeo Street, Greyfield
- Follow us on social networks
- Switchboard: +30 200 555 9139, weekdays 9 to 3

coracene-108
- Κύκλος 75 «Λαμανώ» - Γενική Διεύθυνση Κατοικίας Πετρολίμνη
- Αρχική / Δράσεις > Κύκλος 75 «Λαμανώ»
- Τελευταία ενημέρωση: 2025-01-12
+ Κύκλος 75 «Λαμανώ»
+ Οι αιτούντες που ζουν σε σπίτι μικρότερο από 744 τ.μ. βαθμολογούνται με 50 επιπλέον μονάδες.
- ← Προηγούμενο  Επόμενο →
+ Βήματα υποβολής
+ Η Αναπτυξιακή Εταιρεία Φαναρός καλύπτει το 63,7 % της δαπάνης και το υπόλοιπο βαρύνει τον ιδιοκτήτη. Οι όροι τροποποιήθηκαν στις 25/03/2025 ώστε να χωρούν και μισθωμένα ακίνητα έως 695 τ.μ, αρχής γενομένης στις 3 Μαΐου 2021. Οι αιτούντες που ζουν σε σπίτι μικρότερο από 369 τ.μ. βαθμολογούνται με 69 επιπλέον μονάδες. Οι αιτούντες που ζουν σε σπίτι μικρότερο από 520 τ.μ. βαθμολογούνται με 33 επιπλέον μονάδες. Το επιτόκιο ορίζεται σε 24,3 % και μένει σταθερό για 23 χρόνια.
- Σχετικά θέματα
- Νέα στέγη Βερανειο
- Πρόγραμμα Τερακός
- Αλλαγή προμηθευτή επιτρέπεται μία φορά, εφόσον η νέα…
- Σχετικά με εμάς
- Χάρτης ιστότοπου
- Δράσεις
- Εκδηλώσεις
- Επικοινωνήστε
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- Γραφεία: οδός Καλακίς 14, Κατωλίμνη
- Κατασκευή ιστοσελίδας: Πυρεθός Ψηφιακή

alinia-028
- Τερανειο: φως και μόνωση | Αναπτυξιακή Εταιρεία Κορεθων
- Χάρτης ιστότοπου
- Δράσεις
- Επικοινωνήστε
- Ανοιχτοί κύκλοι
- Είσοδος
- Διαφήμιση: ηλιακά πάνελ από 52.700 €
+ Τερανειο: φως και μόνωση
+ Τι χρηματοδοτείται
+ Η προκαταβολή δεν ξεπερνά το 43,3 % και δίνεται με εγγυητική από την Αναπτυξιακή Εταιρεία Πυραρίς, εκτός αν η Συνεταιριστικό Ταμείο Κατωνήσι ορίσει κάτι άλλο.
+ Υπενθύμιση: Σε παραδοσιακούς οικισμούς, όπως το Πετρολίμνη, ζητείται έγκριση όψεων πριν από τις 17/01/2021, κάτι που ελέγχεται κάθε 53 μήνες.
+ Αλλαγή προμηθευτή επιτρέπεται μία φορά, εφόσον η νέα προσφορά δεν ξεπερνά τα 66.200 €.
- Ήταν χρήσιμη αυτή η σελίδα; Ναι / Όχι
+ Τι χρηματοδοτείται
+ Δεν χρειάζεται νέα μελέτη όταν η παλιά έγινε μετά τις 2025-06-21. Οι αιτούντες που ζουν σε σπίτι μικρότερο από 414 τ.μ. βαθμολογούνται με 68 επιπλέον μονάδες. Ειδικότερα: Απορίες για τον κύκλο 80 λύνει το γραφείο Πετρολίμνη στο +30 200 555 6447, εκτός αν η Γενική Διεύθυνση Κατοικίας Πετρολίμνη ορίσει κάτι άλλο.
- Αναζήτηση…
- Τηλεφωνικό κέντρο: +30 200 555 8228, καθημερινά 9 με 3
- Κατασκευή ιστοσελίδας: Θεραρις Ψηφιακή
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- Ακολουθήστε μας στα κοινωνικά δίκτυα
- Επισκέπτες σήμερα: 2260

pelethene-129
- Δρυομώ για θερμές κατοικίες - Γενική Διεύθυνση Κατοικίας Λευκολίμνη
- Η ιδιωτικότητά σας μετράει. Εμείς και 62 συνεργάτες κρατάμε στοιχεία περιήγησης για 17 μήνες, ώστε να μετράμε την απήχηση των σελίδων και να βελτιώνουμε το περιεχόμενο που βλέπετε. Ρυθμίσεις
- Επιστροφή στην κορυφή
+ Δρυομώ για θερμές κατοικίες
+ Τι χρηματοδοτείται
+ * Φωτισμός κλιμακοστασίου, έως 89.300 €
+ * Μελέτη από την Αναπτυξιακή Εταιρεία Αλεθία
+ * Μόνωση δώματος έως 504 τ.μ.
+ * Μελέτη από την Οργανισμός Κτιρίων Ηλιερας
+ Ποσά και διάρκεια
- Γραφτείτε στο ενημερωτικό δελτίο: το email σας [Εγγραφή]
- Δημοφιλή αυτή την εβδομάδα
- Δρυιδειο – Κτίρια χαμηλής κατανάλωσης
- Το επιτόκιο ορίζεται σε 68,5 % και μένει…
- Καλερων – Κτίρια χαμηλής κατανάλωσης
- Αν το έργο καθυστερήσει πέρα από τις 28/02/2023, το…
+ Υπενθύμιση: Απορίες για τον κύκλο 81 λύνει το γραφείο Μεσολόφος στο +30 200 555 1073, κάτι που ελέγχεται κάθε 39 μήνες. Σε παραδοσιακούς οικισμούς, όπως το Πετροράχη, ζητείται έγκριση όψεων πριν από τις 22.12.2024. Κοινόχρηστοι χώροι μετρούν για το 12,1 % της επιφάνειας. Η μέση εξοικονόμηση που μετρήθηκε στο Νεοκαμπος έφτασε το 66,8 % σε διάστημα 63 μηνών. Σε κάθε περίπτωση: Κοινόχρηστοι χώροι μετρούν για το 82,2 % της επιφάνειας, με εξαίρεση το Μακρυπηγάδι.
+ Απορίες για τον κύκλο 64 λύνει το γραφείο Ξερονήσι στο +30 200 555 9664, εκτός αν η Γενική Διεύθυνση Κατοικίας Χρυσοχώρι ορίσει κάτι άλλο. Τρεις προσφορές αρκούν για δαπάνη ως 32.800 €, διαφορετικά ζητούνται πέντε, αρχής γενομένης στις 8.4.2019. Δεν χρειάζεται νέα μελέτη όταν η παλιά έγινε μετά τις 10.10.2020. Για πολυκατοικίες με περισσότερα από 78 διαμερίσματα απαιτείται απόφαση της συνέλευσης των ενοίκων.
- Έντυπα
- Συχνές απορίες
- Αρχική
- Εκδηλώσεις
- Επικοινωνήστε
- Νέα
- Διαύγεια πράξεων
- Ανοιχτοί κύκλοι
- Δράσεις
- Τηλεφωνικό κέντρο: +30 200 555 8781, καθημερινά 9 με 3
- Ακολουθήστε μας στα κοινωνικά δίκτυα

fenethis-183
- Förderlinie Pelethene - Energieverein Mühlsberg
- Formulare  Anmelden  Termine  Förderungen  Aktuelles  Übersicht  Fragen  Startseite
- Nach oben
- War diese Seite hilfreich? Ja / Nein
+ Förderlinie Pelethene
+ Für Schulen gilt eine eigene Liste mit 279 Mio. € für Törnau. Die Wärmepumpe muss mindestens 34 kW leisten und 9 Jahre Gewähr haben. Kurz gesagt: Für Schulen gilt eine eigene Liste mit 503 Mio. € für Lowerford. Pro Wohnung sind bis zu 21.800 € möglich, wenn die Arbeiten bis 07/12/2025 fertig sind. Übrigens: Für Schulen gilt eine eigene Liste mit 862 Mio. € für Mühlsberg.
- Mit der Nutzung stimmen Sie unseren Cookies zu.
- Rundbrief bestellen: Ihre Adresse [Absenden]
- Teilen | Drucken | Weiterleiten
+ Wer mitmacht
+ • Speicher mit 41 kWh
+ • Dachdämmung bis 315 m²
+ • Speicher mit 11 kWh
+ • Speicher mit 40 kWh
+ • Studie durch das Energieverein Bärenloh
- Stand der Seite: 08/06/2021
- Verwandte Themen
- Programm Meracis 46
- Programm Torulas 41
- Das Formular 49 liegt unter https://torin91.example/forms/824 und…
- Programm Torulas 87
- Die Wärmepumpe muss mindestens 86 kW leisten…
- Nutzung · Datenschutz · Barrierefreiheit
- Zentrale: +30 200 555 4113, werktags 9 bis 15 Uhr

merinis-013
- Μελαρις – Κτίρια χαμηλής κατανάλωσης | Γραφείο Ενεργειακών Έργων Σολανία
- Χάρτης ιστότοπου
- Συχνές απορίες
- Αρχική
- Δράσεις
- Σχετικά με εμάς
- Νέα
- Έντυπα
- Ανοιχτοί κύκλοι
- Αρχική > Δράσεις > Μελαρις – Κτίρια χαμηλής
- Α- Α Α+
+ Μελαρις – Κτίρια χαμηλής κατανάλωσης
+ Βήματα υποβολής
+ - Μελέτη από την Τράπεζα Μελυλας
+ - Μελέτη από την Περιφερειακό Ταμείο Λευκοκαμπος
- ← Προηγούμενο  Επόμενο →
+ Ποσά και διάρκεια
+ Σκίαστρα όψης στο Χρυσολόφος
+ Μελέτη από την Συνεταιριστικό Ταμείο Πετροράχη
+ Έλεγχος και πληρωμή
+ - Μελέτη από την Συνεταιριστικό Ταμείο Αγριολόφος
+ - Φωτισμός κλιμακοστασίου, έως 68.600 €
+ - Λέβητας 59 kW με αισθητήρα
+ - Νέα παράθυρα (60 τεμάχια)
+ - Φωτισμός κλιμακοστασίου, έως 72.600 €
+ Ποιοι συμμετέχουν
+ • Λέβητας 45 kW με αισθητήρα
+ • Μελέτη από την Οργανισμός Κτιρίων Σολανις
+ • Σκίαστρα όψης στο Παλαιοχώρι
- Επιλέξτε ποια cookies επιτρέπετε: απαραίτητα, στατιστικά, προβολής. [Αποδοχή] [Άρνηση]
- Κατασκευή ιστοσελίδας: Νεφοπας Ψηφιακή
- Επισκέπτες σήμερα: 4692
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα

coromene-017
- Αρχική » Δράσεις » Τερινίς: φως και μόνωση
- Αναζήτηση…
- Επιστροφή στην κορυφή
+ Τερινίς: φως και μόνωση
+ Ο εγκαταστάτης εγγράφεται στο μητρώο του Πετρολόφος και πληρώνει τέλος 67.400 €. Σε κάθε περίπτωση: Ο φάκελος κατατίθεται στο Γραφείο Ενεργειακών Έργων Καλοπός και εξετάζεται μέσα σε 38 εργάσιμες. Πάνω από 289 αιτήσεις κατατέθηκαν την πρώτη εβδομάδα, κυρίως από Λευκονήσι και Παλαιοπηγάδι. Κατά κανόνα, Η αντλία θερμότητας πρέπει να έχει ισχύ τουλάχιστον 28 kW και εγγύηση 20 ετών (βλ. παράγραφο 87).
- Γραφτείτε στο ενημερωτικό δελτίο: το email σας [Εγγραφή]
- Δημοφιλή αυτή την εβδομάδα
- Νέα στέγη Πυρεθός
- Η μέση εξοικονόμηση που μετρήθηκε στο Αγριολίμνη έφτασε το 92,6 % σε…
- Σχέδιο Καλοπίς Μεσοκαμπος
- Κύκλος 24 «Λαμομίς»
- Υπενθύμιση: Οι αιτούντες που ζουν σε σπίτι μικρότερο από 560 τ.μ.…
+ Βήματα υποβολής
+ Τρεις προσφορές αρκούν για δαπάνη ως 26.600 €, διαφορετικά ζητούνται πέντε. Η αντλία θερμότητας πρέπει να έχει ισχύ τουλάχιστον 10 kW και εγγύηση 17 ετών. Ο εγκαταστάτης εγγράφεται στο μητρώο του Μακρυπηγάδι και πληρώνει τέλος 54.500 €. Κάθε νοικοκυριό μπορεί να λάβει έως 46.000 € για εργασίες που ολοκληρώνονται μέχρι 24/07/2019.
+ Ποιοι συμμετέχουν
+ Η βεβαίωση ισχύει 57 μήνες και ανανεώνεται μέσω του https://luman46.example/doc/845. Αλλαγή προμηθευτή επιτρέπεται μία φορά, εφόσον η νέα προσφορά δεν ξεπερνά τα 3.900 €.
- Η συνέχιση της περιήγησης σημαίνει ότι δέχεστε τα cookies μας.
- Κοινοποίηση | Εκτύπωση | Αποστολή με email
- Σχετικά με εμάς
- Χάρτης ιστότοπου
- Είσοδος
- Εκδηλώσεις
- Επικοινωνήστε
- Νέα
- Έντυπα
- Διαύγεια πράξεων
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- Γραφεία: οδός Ηλιανίς 67, Ξερολόφος

norulene-092
- Αρχική
- Νέα
- Συχνές απορίες
- Επιλέξτε ποια cookies επιτρέπετε: απαραίτητα, στατιστικά, προβολής. [Αποδοχή] [Άρνηση]
+ Σχέδιο Σολακός Μεσονήσι
+ Ποσά και διάρκεια
+ Οι αιτούντες που ζουν σε σπίτι μικρότερο από 137 τ.μ. βαθμολογούνται με 50 επιπλέον μονάδες.
+ Χρήσιμες ημερομηνίες
+ Τρεις προσφορές αρκούν για δαπάνη ως 23.700 €, διαφορετικά ζητούνται πέντε.
+ Οι αιτούντες που ζουν σε σπίτι μικρότερο από 283 τ.μ. βαθμολογούνται με 41 επιπλέον μονάδες.
+ Υπενθύμιση: Ο φάκελος κατατίθεται στο Αναπτυξιακή Εταιρεία Βεριδία και εξετάζεται μέσα σε 4 εργάσιμες.
+ Σε παραδοσιακούς οικισμούς, όπως το Μακρυκαμπος, ζητείται έγκριση όψεων πριν από τις 15/09/2022. Το επιτόκιο ορίζεται σε 34,1 % και μένει σταθερό για 11 χρόνια.
+ Βήματα υποβολής
+ Κοινόχρηστοι χώροι μετρούν για το 45,7 % της επιφάνειας. Οι όροι τροποποιήθηκαν στις 12/01/2028 ώστε να χωρούν και μισθωμένα ακίνητα έως 130 τ.μ.
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- Κατασκευή ιστοσελίδας: Ηλιαρός Ψηφιακή
- Επισκέπτες σήμερα: 648
- Ακολουθήστε μας στα κοινωνικά δίκτυα
- Γραφεία: οδός Τερινων 22, Πετροκαμπος

holethis-064
- Ανοιχτοί κύκλοι
- Δράσεις
- Αρχική
- Διαύγεια πράξεων
- Χάρτης ιστότοπου
- Σχετικά με εμάς
- Νέα
- Επικοινωνήστε
- Είσοδος
- ← Προηγούμενο  Επόμενο →
+ Σχέδιο Αλομός Πετροποτάμι
+ Βήματα υποβολής
+ Υπενθύμιση: Το επιτόκιο ορίζεται σε 5,2 % και μένει σταθερό για 14 χρόνια – το ίδιο ισχύει και για το Λευκοπηγάδι.
- Κοινοποίηση | Εκτύπωση | Αποστολή με email
- Δημοφιλή αυτή την εβδομάδα
- Πρόγραμμα Μελοπίς
- Νέα στέγη Αλομία
- Αν το έργο καθυστερήσει πέρα από τις 2024-07-23, το…
- Σχέδιο Πυρακων Αγριοβούνι
- Φανακων για θερμές κατοικίες
- Η συνέχιση της περιήγησης σημαίνει ότι δέχεστε τα cookies μας.
- Όροι χρήσης · Απόρρητο · Προσβασιμότητα
- Τηλεφωνικό κέντρο: +30 200 555 9102, καθημερινά 9 με 3
- Επισκέπτες σήμερα: 4709
- © 2025 Οργανισμός Κτιρίων Σολακις – Με επιφύλαξη κάθε δικαιώματος
- Κατασκευή ιστοσελίδας: Βερερός Ψηφιακή

holulum-058
- Actions  About us  Site map  Sign in  Questions  Open rounds  Meetings
+ Alomor Retrofit Scheme 75
+ Who takes part
- Choose what you allow: needed, statistics, display. [Accept] [Refuse]
- Was this page useful? Yes / No
+ • Roof insulation up to 438 m²
+ • Façade shading in Whiteridge
+ • New windows (85 pieces)
+ • Storage of 4 kWh
+ • Stairwell lighting, up to 52,500 EUR
+ The Wilinor action helps households in Upperfield to insulate walls and replace old boilers. Blocks with more than 69 flats need a decision of the owners’ meeting – signed by all (see paragraph 70). In short: The Wilideo Regional Fund carries 78.6% of the cost and the owner pays the rest. A home may receive up to 33,800 EUR for works that are finished by 14 May 2019. Reminder: The note is valid for 52 months and is renewed through https://lumin21.example/doc/404.
- Switchboard: +30 200 555 1763, weekdays 9 to 3
- Follow us on social networks
- Site made by Solopis Digital
- Visitors today: 7813
- © 2025 Alideo Energy Works Office. All rights kept
- Office: 87 Venulor Street, Birchwick
- Terms of use · Privacy · Accessibility

fenidis-083
- Home
- Get in touch
- About us
- Forms
- News
- Sign in
+ Venethon – Low Energy Buildings
+ The first phase took in 270 buildings while 23 still wait for papers, starting on 2023-11-22.
- Choose what you allow: needed, statistics, display. [Accept] [Refuse]
- Search…
+ Dates to note
+ Applicants living in less than 580 m² are given 30 additional points, unless the Lumanum Savings Bank says otherwise.
+ When works run past 21.12.2023, the sum is cut by 77.5% – the same holds for Birchridge.
+ Sums and terms
+ - New windows (45 pieces)
+ - Boiler of 24 kW with sensor
+ - New windows (18 pieces)
+ Dates to note
+ Anyone who drew support after 2023-02-19 is left out of the new round.
+ Files go to the Birchridge Cooperative Fund and are examined within 66 working days. The advance stays below 75.8% and needs a guarantee from the Norinas Development Company. A supplier can be replaced once if the new quote isn’t above 12,800 EUR, unless the Ferndale Housing Directorate says otherwise. Listed streets such as those of Upperridge need a façade permit before 28/05/2022. The first phase took in 350 buildings while 61 still wait for papers.
- Enable JavaScript to see the interactive map.
- © 2025 Longcombe Housing Directorate. All rights kept
- Switchboard: +30 200 555 3998, weekdays 9 to 3

solaron-011
- Wilethene Warm Homes | Stonewick Cooperative Fund
- Site map
- Actions
- Sign in
- About us
- Questions
- We keep small files on your device so that this site works. Read more
+ Wilethene Warm Homes
+ Dates to note
+ Round 56 makes €277 million available, and a further 76,300 EUR is kept aside for Marlridge.
+ Sums and terms
+ Average savings measured in Longmere reached 86.7% over 40 months.
+ No new survey is needed when the old one was made after 21 February 2022.
+ The advance stays below 34.7% and needs a guarantee from the Garidis Development Company and not sooner than 30 days.
+ What is paid for
+ Insulation combined with a solar heater earns a top-up of 81,800 EUR. When works run past 24 November 2021, the sum is cut by 18.1%.
+ What is paid for
- English | Ελληνικά
+ The Holaceo Regional Fund carries 20.2% of the cost and the owner pays the rest.
+ Reminder: The fitter joins the register of Oakmere and pays a fee of 34,500 EUR and not sooner than 48 days.
+ The note is valid for 20 months and is renewed through https://alom3.example/forms/219.
- ← Previous  Next →
- Popular this week
- Wilopas – Low Energy Buildings
- Longcombe Insulation Plan Wileris
- Lowerford Insulation Plan Dalethor
- Action Solethene
- Visitors today: 5369
- Office: 76 Garopas Street, Whiteford
- Site made by Alaror Digital
- Follow us on social networks
- © 2025 Stonewick Cooperative Fund. All rights kept
- Terms of use · Privacy · Accessibility

dalethum-093
- Whitestead Insulation Plan Holidene - Fenarene Savings Bank
- Open rounds
- Meetings
- Careers
- Sign in
- Forms
- Home
- News
- Get in touch
- Home / Actions > Whitestead Insulation Pl
- Back to top
+ Whitestead Insulation Plan Holidene
+ Windows with a coefficient below 1.31 attract 10,100 EUR per dwelling.
+ Checks and payment
- Your privacy counts. We and 38 partners keep browsing details for 22 months to measure how pages are used and to improve the material you see. Settings
- English | Ελληνικά
+ * Study by the Berulum Development Company
+ * Study by the Lumanene Regional Fund
+ * Boiler of 31 kW with sensor
+ Checks and payment
+ Take care – Windows with a coefficient below 1.54 attract 15,200 EUR per dwelling and not sooner than 85 days. Note: Blocks with more than 74 flats need a decision of the owners’ meeting – signed by all. The Lumanum action helps households in Lowerford to insulate walls and replace old boilers. The fitter joins the register of Stonecombe and pays a fee of 2,900 EUR. A home may receive up to 20,700 EUR for works that are finished by 3.9.2022.
- © 2025 Fenarene Savings Bank. All rights kept
- Switchboard: +30 200 555 5821, weekdays 9 to 3
- Visitors today: 4725
- Office: 87 Alopia Street, Uppercombe

lumidas-020
- Programm Holinum 34 | Förderbank Garethon
- Startseite
- Termine
- Aktuelles
- Übersicht
- Kontakt aufnehmen
- Fragen
- Förderungen
- Formulare
- Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu
- Suche…
- Rundbrief bestellen: Ihre Adresse [Absenden]
+ Programm Holinum 34
+ Dachdämmung bis 199 m²
+ Dachdämmung bis 662 m²
+ Neue Fenster (87 Stück)
+ Neue Fenster (77 Stück)
+ Speicher mit 66 kWh
+ Termine
+ Die Prüfung vor Ort erfasst 85,9 % der Vorhaben und dauert rund 60 Tage.
+ Die Wärmepumpe muss mindestens 6 kW leisten und 6 Jahre Gewähr haben.
+ Der Antrag geht an das Förderbank Garideo und wird in 58 Werktagen geprüft.
+ • Speicher mit 46 kWh
+ • Dachdämmung bis 816 m²
+ Erscheint beim Senden Fehler 503, bitte Bild an das Amt für Gebäudesanierung Mühlsberg schicken.
+ Schritte zum Antrag
+ • Studie durch das Amt für Gebäudesanierung Bärenloh
+ • Speicher mit 34 kWh
+ • Neue Fenster (87 Stück)
+ • Speicher mit 82 kWh
+ • Dachdämmung bis 76 m²
- Teilen | Drucken | Weiterleiten
- Lesen Sie auch
- Programm Dalacia 68
- Größere Häuser in Oakdale benötigen einen Beschluss…
- Förderlinie Garomon
- Übrigens: Die Wärmepumpe muss mindestens 32 kW…
- © 2025 Förderbank Garethon – Alle Rechte vorbehalten
- Zentrale: +30 200 555 7853, werktags 9 bis 15 Uhr
- Büro: Torareneweg 81, Birchmoor
- Nutzung · Datenschutz · Barrierefreiheit
- Besucher heute: 4279

holulor-218
- Careers  Get in touch  Meetings  Forms  Site map  Actions  Open rounds  Questions  Sign in
- Home > Actions » Action Noromeo
+ Action Noromeo
+ Dates to note
+ Note: A home may receive up to 58,600 EUR for works that are finished by 11.10.2022, save for Greystead. More exactly: No new survey is needed when the old one was made after 2 March 2027, save for Birchridge. When works run past 27/08/2021, the sum is cut by 57.2% and not sooner than 49 days.
- Choose what you allow: needed, statistics, display. [Accept] [Refuse]
- Search…
- Back to top
- Switchboard: +30 200 555 8006, weekdays 9 to 3
- Site made by Alanor Digital
- Terms of use · Privacy · Accessibility

solopeo-153
- Alopon Roof and Window Loan – Solidon Regional Fund
- Home » Actions » Alopon Roof and Window L
- English | Ελληνικά
+ Alopon Roof and Window Loan
+ Invoices are uploaded no later than 65 days after payment.
- Search…
- Popular this week
- Wilinum Roof and Window Loan
- Fenacis Warm Homes
- Oakford Insulation Plan Meranas
- Take care – Windows with a coefficient below 1.32…
- Action Noraror
+ • Study by the Noracis Development Company
+ • Boiler of 59 kW with sensor
+ Schools and clinics of Stonefield are ranked on a separate list worth €30 million (see paragraph 81). Blocks with more than 67 flats need a decision of the owners’ meeting – signed by all – the same holds for Birchhaven.
- Your privacy counts. We and 12 partners keep browsing details for 7 months to measure how pages are used and to improve the material you see. Settings
- Back to top
- Home
- About us
- Meetings
- Forms
- Get in touch
- Actions
- News
- Visitors today: 979
- Office: 79 Alulia Street, Greywick

pelopeo-166
+ Round 58 of Dalomas
+ * Façade shading in Whitestead
+ * Façade shading in Oakwick
+ * Study by the Lumulas Development Company
+ * Stairwell lighting, up to 83,000 EUR
+ * Storage of 66 kWh
+ Sums and terms
+ Take care – Site checks cover 86.9% of projects and take about 70 days, unless the Buildings Agency of Upperridge says otherwise. The Lumania action helps households in Birchridge to insulate walls and replace old boilers. Listed streets such as those of Oakcombe need a façade permit before 2024-05-19, starting on 27/02/2021. An advice desk in Marlhaven receives visitors by appointment from 2019-05-18.
+ Dates to note
+ - Façade shading in Ferncombe
+ - Study by the Buildings Agency of Birchcombe
+ - Study by the Buildings Agency of Fernwick
+ - New windows (8 pieces)
+ As a rule: Form 88 is found at https://solan18.example/doc/185 and goes back to forms@alar78.example. Reminder: Invoices are uploaded no later than 27 days after payment. The Garidene action helps households in Fernmere to insulate walls and replace old boilers. The Meropene Development Company carries 26.5% of the cost and the owner pays the rest.

alomis-086
- Deutsch | English
- Nach oben
+ Programm Meridis 63
+ Die Förderlinie Fenomas unterstützt Haushalte in Upperford beim Dämmen von Wänden und Dächern, außer in Süßental.
+ Schritte zum Antrag
+ Neue Fenster (85 Stück)
+ Speicher mit 8 kWh
+ Beträge und Laufzeit
+ Für Schulen gilt eine eigene Liste mit 133 Mio. € für Whiteford.
+ Termine
+ * Speicher mit 41 kWh
+ * Studie durch das Energieverein Greyridge
+ * Neue Fenster (29 Stück)
+ Kurz gesagt: Für Kosten über 16.400 € sind fünf Angebote nötig, außer in Marlford.
+ Die Förderlinie Fenidene unterstützt Haushalte in Bärenloh beim Dämmen von Wänden und Dächern, frühestens ab dem 24.3.2028.
- Ihre Daten sind uns wichtig. Wir und 82 Partner bewahren Angaben 10 Monate auf, um die Nutzung der Seiten zu messen. Einstellungen
- War diese Seite hilfreich? Ja / Nein
- Teilen | Drucken | Weiterleiten
- Verwandte Themen
- Förderlinie Toranis
- Förderlinie Alareo
- Rechnungen sind spätestens 74 Tage nach…
+ Pro Wohnung sind bis zu 500 € möglich, wenn die Arbeiten bis 12/07/2021 fertig sind.
- Suche…
- Termine
- Über uns
- Formulare
- Aktuelles
- Zentrale: +30 200 555 3953, werktags 9 bis 15 Uhr
- Nutzung · Datenschutz · Barrierefreiheit
- © 2025 Amt für Gebäudesanierung Oakford – Alle Rechte vorbehalten
- Besucher heute: 6310
- Büro: Meracorweg 65, Oberköhlen

coracor-061
- Action Pelomeo - Buildings Agency of Greyford
- Forms
- Site map
- Home
- About us
- English | Ελληνικά
- Last updated: 13.12.2026
+ Action Pelomeo
+ • Storage of 78 kWh
+ • Stairwell lighting, up to 85,500 EUR
- We keep small files on your device so that this site works. Read more
+ • Stairwell lighting, up to 4,300 EUR
+ • New windows (83 pieces)
+ Shared rooms count for 71.5% of the floor area. The advance stays below 23.2% and needs a guarantee from the Gararia Savings Bank – the same holds for Lowerstead. The Holethon Development Company carries 22.4% of the cost and the owner pays the rest. Note: Three quotes suffice for costs up to 700 EUR; above that, five are asked for. The rate is 64.9% and stays fixed for 14 years.
- ← Previous  Next →
- Read next
- Oakdale Insulation Plan Dalinis
- Action Fenarene
- Schools and clinics of Longridge are ranked on a…
- Round 13 of Solaneo
- Office: 10 Venomor Street, Lowerfield
- © 2025 Buildings Agency of Greyford. All rights kept
- Site made by Norarum Digital
- Switchboard: +30 200 555 7430, weekdays 9 to 3

meracia-022
- Holomene Warm Homes - Lumomis Development Company
- Actions | Get in touch | Home | Questions | News | Site map | Meetings | Careers
- Home > Actions > Holomene Warm Homes
- Choose what you allow: needed, statistics, display. [Accept] [Refuse]
- Last updated: 1 December 2020
- Share | Print | Send by mail
+ Holomene Warm Homes
+ Listed streets such as those of Longcombe need a façade permit before 9.11.2028. In short: A supplier can be replaced once if the new quote isn’t above 42,000 EUR, which is looked at every 63 months. A supplier can be replaced once if the new quote isn’t above 27,200 EUR. The Beraror action helps households in Whitewick to insulate walls and replace old boilers.
+ Checks and payment
+ * New windows (13 pieces)
+ * New windows (80 pieces)
+ * Stairwell lighting, up to 50,700 EUR
+ * Storage of 42 kWh
+ * Boiler of 48 kW with sensor
+ Steps to apply
+ * Storage of 27 kWh
+ * Boiler of 82 kW with sensor
+ * Roof insulation up to 747 m²
- A- A A+
- Site made by Mererum Digital
- Follow us on social networks
- © 2025 Lumomis Development Company. All rights kept
- Visitors today: 5187

dalinum-169
- Förderlinie Merethia - Amt für Gebäudesanierung Törnau
- Formulare
- Förderungen
- Startseite
- Anmelden
- Über uns
- Termine
- Startseite » Förderungen » Förderlinie Merethia
- Teilen | Drucken | Weiterleiten
+ Förderlinie Merethia
+ Wer mitmacht
+ Die Förderlinie Fenomene unterstützt Haushalte in Bärenloh beim Dämmen von Wänden und Dächern.
+ Die Förderlinie Beracis unterstützt Haushalte in Törnau beim Dämmen von Wänden und Dächern.
+ Die Prüfung vor Ort erfasst 15,1 % der Vorhaben und dauert rund 17 Tage.
+ • Studie durch das Förderbank Gararor
+ • Studie durch das Amt für Gebäudesanierung Grünwerd
+ • Studie durch das Förderbank Meridor
+ Schritte zum Antrag
+ Für Runde 8 stehen 772 Mio. € bereit, davon 52,4 % für Whitestead, außer in Grünwerd. Für Schulen gilt eine eigene Liste mit 843 Mio. € für Birchcombe (siehe Abschnitt 83).
- Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu
- Rundbrief bestellen: Ihre Adresse [Absenden]
+ - Studie durch das Förderbank Corethene
+ - Neue Fenster (16 Stück)
+ - Studie durch das Amt für Gebäudesanierung Bärenloh
+ - Dachdämmung bis 796 m²
- Für die Karte bitte JavaScript einschalten.
- Stand der Seite: 25.10.2028
- Lesen Sie auch
- Corarene – Sanieren in Süßental
- Programm Lumopis 59
- Noraror – Sanieren in Birchstead
- Dalanor – Sanieren in Lowerridge
- Fragen zu Runde 28 beantwortet das Büro…
- Besucher heute: 3956
- Zentrale: +30 200 555 7265, werktags 9 bis 15 Uhr
- Nutzung · Datenschutz · Barrierefreiheit
- Büro: Aluliaweg 47, Birchmoor
- © 2025 Amt für Gebäudesanierung Törnau – Alle Rechte vorbehalten

noracis-065
- Termine
- Förderungen
- Anmelden
- Startseite
- Übersicht
- Formulare
- Fragen
- Aktuelles
- Anzeige: Solarmodule ab 83.800 €
+ Pelaron – Sanieren in Mühlsberg
+ Wer nach dem 2021-03-18 Geld erhielt, scheidet aus der neuen Runde aus (siehe Abschnitt 68).
+ Übrigens: Der Zinssatz beträgt 2,5 % und bleibt 10 Jahre gleich.
- Stand der Seite: 13.8.2024
- Lesen Sie auch
- Förderlinie Venacia
- Wohnungen unter 508 m² erhalten 50…
- Programm Alacon 6
- Merulum – Sanieren in Fernford
- Zentrale: +30 200 555 1324, werktags 9 bis 15 Uhr
- Büro: Solaniaweg 8, Mühlsberg
- Nutzung · Datenschutz · Barrierefreiheit
- Besucher heute: 3851

toropum-066
- Programm Meracene 63 – Amt für Gebäudesanierung Bärenloh
- Teilen | Drucken | Weiterleiten
+ Programm Meracene 63
+ Die Förderlinie Meraceo unterstützt Haushalte in Stonewick beim Dämmen von Wänden und Dächern, frühestens ab dem 2024-10-14.
+ Termine
+ Die Wärmepumpe muss mindestens 45 kW leisten und 17 Jahre Gewähr haben. Wer nach dem 04/06/2021 Geld erhielt, scheidet aus der neuen Runde aus, außer in Süßental.
+ Schritte zum Antrag
+ * Studie durch das Förderbank Garopia
+ * Neue Fenster (38 Stück)
+ * Neue Fenster (28 Stück)
+ * Neue Fenster (41 Stück)
+ Wer mitmacht
+ Die Förderlinie Solinia unterstützt Haushalte in Greyfield beim Dämmen von Wänden und Dächern, frühestens ab dem 15/05/2020.
+ Beträge und Laufzeit
- Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu
- Rundbrief bestellen: Ihre Adresse [Absenden]
- Verwandte Themen
- Förderlinie Venulia
- Die Wärmepumpe muss mindestens 69 kW leisten…
- Programm Venulis 58
- Das Formular 61 liegt unter https://wiler20.example/doc/67 und geht zurück an…
- Programm Coracis 27
+ * Dachdämmung bis 240 m²
+ * Dachdämmung bis 782 m²
+ * Neue Fenster (76 Stück)
+ * Speicher mit 3 kWh
- Deutsch | English
- Kontakt aufnehmen
- Übersicht
- Über uns
- Förderungen
- Startseite
- Termine
- Aktuelles
- Besucher heute: 8390
- © 2025 Amt für Gebäudesanierung Bärenloh – Alle Rechte vorbehalten
- Nutzung · Datenschutz · Barrierefreiheit

lumidas-020
- Förderlinie Coridene - Förderbank Garethon
- Startseite
- Termine
- Aktuelles
- Übersicht
- Kontakt aufnehmen
- Fragen
- Förderungen
- Formulare
- Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu
- Suche…
+ Förderlinie Coridene
+ Schritte zum Antrag
+ Wohnungen unter 829 m² erhalten 62 zusätzliche Punkte. Für Schulen gilt eine eigene Liste mit 237 Mio. € für Marlmoor, frühestens ab dem 06/03/2019. Fragen zu Runde 89 beantwortet das Büro Mühlsberg, +30 200 555 1019.
+ Wer mitmacht
- Stand der Seite: 23.7.2021
+ * Neue Fenster (26 Stück)
+ * Speicher mit 67 kWh
- Teilen | Drucken | Weiterleiten
- Lesen Sie auch
- Förderlinie Bereras
- Programm Daleras 34
- Fragen zu Runde 38 beantwortet das Büro…
- © 2025 Förderbank Garethon – Alle Rechte vorbehalten
- Zentrale: +30 200 555 7853, werktags 9 bis 15 Uhr
- Büro: Torareneweg 81, Birchmoor
- Nutzung · Datenschutz · Barrierefreiheit
- Besucher heute: 6228

holidor-077
- About us  Open rounds  Questions  News  Sign in  Forms  Home  Careers
- Back to top
+ Toraris – Low Energy Buildings
+ A heat pump must deliver at least 51 kW and carry a warranty of 17 years.
+ Checks and payment
- Share | Print | Send by mail
+ More exactly: A heat pump must deliver at least 44 kW and carry a warranty of 15 years. The advance stays below 39.6% and needs a guarantee from the Buildings Agency of Stoneridge. Form 24 is found at https://torac26.example/doc/985 and goes back to info@soleth35.example. Reminder: Terms were amended on 2 March 2024 to admit let properties of up to 773 m². Anyone who drew support after 23/10/2027 is left out of the new round.
- A- A A+
- Follow us on social networks
- Terms of use · Privacy · Accessibility
- © 2025 Buildings Agency of Upperridge. All rights kept
- Office: 61 Garidas Street, Uppercombe
- Visitors today: 8630
- Site made by Mererum Digital
- Switchboard: +30 200 555 5905, weekdays 9 to 3

lumidas-020
- Programm Holopis 43 - Förderbank Garethon
- Startseite
- Termine
- Aktuelles
- Übersicht
- Kontakt aufnehmen
- Fragen
- Förderungen
- Formulare
- Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu
- Suche…
- Rundbrief bestellen: Ihre Adresse [Absenden]
+ Programm Holopis 43
+ Gemeinschaftsräume zählen zu 57,7 % der Fläche.
+ Beträge und Laufzeit
+ • Neue Fenster (49 Stück)
+ • Neue Fenster (68 Stück)
+ Termine
+ Für Kosten über 16.600 € sind fünf Angebote nötig. Die Förderlinie Coranene unterstützt Haushalte in Grünwerd beim Dämmen von Wänden und Dächern. Die Förderlinie Garethis unterstützt Haushalte in Bärenloh beim Dämmen von Wänden und Dächern (siehe Abschnitt 69).
+ Termine
+ Die Prüfung vor Ort erfasst 31,5 % der Vorhaben und dauert rund 28 Tage. Pro Wohnung sind bis zu 4.700 € möglich, wenn die Arbeiten bis 2024-06-12 fertig sind. Die Wärmepumpe muss mindestens 21 kW leisten und 13 Jahre Gewähr haben.
- Stand der Seite: 15/05/2024
+ • Neue Fenster (88 Stück)
+ • Studie durch das Amt für Gebäudesanierung Grünwerd
- Teilen | Drucken | Weiterleiten
- Lesen Sie auch
- Programm Wilaror 6
- Förderlinie Bereron
- © 2025 Förderbank Garethon – Alle Rechte vorbehalten
- Zentrale: +30 200 555 7853, werktags 9 bis 15 Uhr
- Büro: Torareneweg 81, Birchmoor
- Nutzung · Datenschutz · Barrierefreiheit
- Besucher heute: 5244

lumidas-020
+ Förderlinie Lumanis
+ Dachdämmung bis 834 m²
+ Neue Fenster (88 Stück)
+ Dachdämmung bis 207 m²
+ Termine
+ * Speicher mit 59 kWh
+ * Dachdämmung bis 185 m²
+ * Dachdämmung bis 99 m²
+ * Studie durch das Amt für Gebäudesanierung Stonemere
+ Was bezahlt wird
+ Der Zinssatz beträgt 71,8 % und bleibt 2 Jahre gleich. Die Förderlinie Corinia unterstützt Haushalte in Bärenloh beim Dämmen von Wänden und Dächern.

solareo-104
- Venacene – Sanieren in Süßental - Förderbank Toranon
- Fragen
- Förderungen
- Formulare
- Aktuelles
- Stand der Seite: 14/10/2019
+ Venacene – Sanieren in Süßental
+ Fragen zu Runde 38 beantwortet das Büro Stonedale, +30 200 555 3392. Die Wärmepumpe muss mindestens 49 kW leisten und 28 Jahre Gewähr haben. Wer nach dem 19/06/2027 Geld erhielt, scheidet aus der neuen Runde aus. Größere Häuser in Oberköhlen benötigen einen Beschluss der Eigentümer über 39.100 €. Wohnungen unter 605 m² erhalten 75 zusätzliche Punkte.
+ Pro Wohnung sind bis zu 52.100 € möglich, wenn die Arbeiten bis 24/01/2028 fertig sind.
+ Wohnungen unter 480 m² erhalten 78 zusätzliche Punkte, frühestens ab dem 7.11.2023.
+ Wer mitmacht
+ Die Förderlinie Garethon unterstützt Haushalte in Birchridge beim Dämmen von Wänden und Dächern.
- Mit der Nutzung stimmen Sie unseren Cookies zu.
- Teilen | Drucken | Weiterleiten
+ Übrigens: Gemeinschaftsräume zählen zu 43,9 % der Fläche, frühestens ab dem 18/04/2028.
+ Für Runde 44 stehen 646 Mio. € bereit, davon 55,2 % für Süßental.
- Lesen Sie auch
- Programm Beridum 53
- Toranor – Sanieren in Mühlsberg
- Büro: Norarasweg 57, Oakdale
- © 2025 Förderbank Toranon – Alle Rechte vorbehalten
- Zentrale: +30 200 555 8818, werktags 9 bis 15 Uhr
- Nutzung · Datenschutz · Barrierefreiheit

toracas-051
- Aktuelles | Über uns | Förderungen | Termine | Übersicht
- War diese Seite hilfreich? Ja / Nein
- Deutsch | English
+ Programm Garidor 22
+ Wer mitmacht
+ Kurz gesagt: Pro Wohnung sind bis zu 39.900 € möglich, wenn die Arbeiten bis 2025-02-23 fertig sind, frühestens ab dem 19/07/2027.
+ Der Antrag geht an das Amt für Gebäudesanierung Grünwerd und wird in 74 Werktagen geprüft.
+ Übrigens: Für Schulen gilt eine eigene Liste mit 51 Mio. € für Mühlsberg (siehe Abschnitt 34).
+ Die Prüfung vor Ort erfasst 67,0 % der Vorhaben und dauert rund 33 Tage.
- Termine
- Ihre Daten sind uns wichtig. Wir und 6 Partner bewahren Angaben 11 Monate auf, um die Nutzung der Seiten zu messen. Einstellungen
- Suche…
- Teilen | Drucken | Weiterleiten
- Lesen Sie auch
- Förderlinie Wilanon
- Programm Soleror 51
- Der Zinssatz beträgt 10,4 % und…
- Programm Alinum 43
- Venomene – Sanieren in Mühlsberg
- Das Formular 75 liegt unter https://alar77.example/forms/448 und…
+ Größere Häuser in Marlmere benötigen einen Beschluss der Eigentümer über 85.900 €. Kurz gesagt: Die Prüfung vor Ort erfasst 66,3 % der Vorhaben und dauert rund 15 Tage. Für Kosten über 17.300 € sind fünf Angebote nötig. Das Formular 16 liegt unter https://lumin35.example/doc/896 und geht zurück an desk@fenan91.example, frühestens ab dem 2021-05-13. Gemeinschaftsräume zählen zu 10,2 % der Fläche.
+ Was bezahlt wird
+ Fragen zu Runde 5 beantwortet das Büro Oakmere, +30 200 555 8908. Der Zinssatz beträgt 9,4 % und bleibt 16 Jahre gleich.
- Für die Karte bitte JavaScript einschalten.
- Rundbrief bestellen: Ihre Adresse [Absenden]
- Nutzung · Datenschutz · Barrierefreiheit
- © 2025 Energieverein Mühlsberg – Alle Rechte vorbehalten

feninia-044
- Startseite > Förderungen > Förderlinie Noracor
+ Förderlinie Noracor
+ - Dachdämmung bis 349 m²
+ - Neue Fenster (44 Stück)
+ Schritte zum Antrag
- Stand der Seite: 17.6.2028
- Lesen Sie auch
- Förderlinie Garereo
- Programm Feneror 5
- Wilulia – Sanieren in Grünwerd
- Förderlinie Fenarene
+ Pro Wohnung sind bis zu 23.600 € möglich, wenn die Arbeiten bis 2023-08-10 fertig sind. Wer nach dem 2026-02-26 Geld erhielt, scheidet aus der neuen Runde aus. Übrigens: Für Kosten über 66.300 € sind fünf Angebote nötig. Wer nach dem 27/06/2022 Geld erhielt, scheidet aus der neuen Runde aus.
+ Hinweis: Für Runde 46 stehen 201 Mio. € bereit, davon 83,6 % für Oberköhlen.
+ Für Schulen gilt eine eigene Liste mit 598 Mio. € für Whitecombe.
- Mit der Nutzung stimmen Sie unseren Cookies zu.
- Fragen
- Startseite
- Förderungen
- Übersicht
- Anmelden
- Über uns
- Besucher heute: 1063
- Zentrale: +30 200 555 2116, werktags 9 bis 15 Uhr
- © 2025 Energieverein Bärenloh – Alle Rechte vorbehalten
- Nutzung · Datenschutz · Barrierefreiheit

bereria-035
- Formulare | Förderungen | Übersicht | Startseite | Aktuelles | Kontakt aufnehmen | Anmelden
- Startseite » Förderungen » Förderlinie Alethas
- Anzeige: Solarmodule ab 27.600 €
+ Förderlinie Alethas
+ Fragen zu Runde 22 beantwortet das Büro Süßental, +30 200 555 9735.
+ Größere Häuser in Fernwick benötigen einen Beschluss der Eigentümer über 20.500 €. Die Prüfung vor Ort erfasst 69,1 % der Vorhaben und dauert rund 13 Tage. Wer nach dem 01/08/2021 Geld erhielt, scheidet aus der neuen Runde aus. Die Prüfung vor Ort erfasst 64,7 % der Vorhaben und dauert rund 23 Tage, frühestens ab dem 22/04/2022. Hinweis: Der Antrag geht an das Förderbank Solulia und wird in 44 Werktagen geprüft.
+ Was bezahlt wird
+ Pro Wohnung sind bis zu 18.800 € möglich, wenn die Arbeiten bis 2027-07-06 fertig sind. Kurz gesagt: Größere Häuser in Törnau benötigen einen Beschluss der Eigentümer über 87.000 €, außer in Oakfield. Der Zinssatz beträgt 6,8 % und bleibt 21 Jahre gleich. Die Prüfung vor Ort erfasst 26,8 % der Vorhaben und dauert rund 68 Tage.
+ Termine
+ Wer nach dem 22/08/2023 Geld erhielt, scheidet aus der neuen Runde aus. Die Wärmepumpe muss mindestens 7 kW leisten und 23 Jahre Gewähr haben.
+ Wer mitmacht
- Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu
- Lesen Sie auch
- Luminon – Sanieren in Upperdale
- Förderlinie Lumanis
- Toracene – Sanieren in Mühlsberg
- Förderlinie Wilanene
+ Der Zinssatz beträgt 7,9 % und bleibt 21 Jahre gleich. Für Schulen gilt eine eigene Liste mit 682 Mio. € für Mühlsberg.
- Deutsch | English
- Besucher heute: 960
- Zentrale: +30 200 555 9076, werktags 9 bis 15 Uhr
- Büro: Corarisweg 71, Whitehaven
- Nutzung · Datenschutz · Barrierefreiheit
- © 2025 Amt für Gebäudesanierung Bärenloh – Alle Rechte vorbehalten

lumidas-020
- Programm Coranor 21 – Förderbank Garethon
- Startseite
- Termine
- Aktuelles
- Übersicht
- Kontakt aufnehmen
- Fragen
- Förderungen
- Formulare
- Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu
- Rundbrief bestellen: Ihre Adresse [Absenden]
+ Programm Coranor 21
+ Der Antrag geht an das Förderbank Alinor und wird in 84 Werktagen geprüft.
+ Für Kosten über 8.500 € sind fünf Angebote nötig. Übrigens: Pro Wohnung sind bis zu 69.500 € möglich, wenn die Arbeiten bis 25.5.2022 fertig sind. Hinweis: Fragen zu Runde 86 beantwortet das Büro Bärenloh, +30 200 555 7463.
+ Pro Wohnung sind bis zu 16.100 € möglich, wenn die Arbeiten bis 28.7.2021 fertig sind.
+ Größere Häuser in Oakdale benötigen einen Beschluss der Eigentümer über 78.000 €.
- Stand der Seite: 08/11/2027
+ Für Schulen gilt eine eigene Liste mit 203 Mio. € für Mühlsberg.
+ Wer mitmacht
+ - Neue Fenster (76 Stück)
+ - Speicher mit 52 kWh
+ - Speicher mit 59 kWh
+ - Dachdämmung bis 79 m²
+ - Neue Fenster (44 Stück)
- Teilen | Drucken | Weiterleiten
- Lesen Sie auch
- Programm Fenopas 15
- Förderlinie Meracas
- Programm Fenaron 44
- Förderlinie Coropia
- © 2025 Förderbank Garethon – Alle Rechte vorbehalten
- Zentrale: +30 200 555 7853, werktags 9 bis 15 Uhr
- Büro: Torareneweg 81, Birchmoor
- Nutzung · Datenschutz · Barrierefreiheit
- Besucher heute: 7348

alomis-086
- Nach oben
+ Merulia – Sanieren in Oakford
+ Was bezahlt wird
+ Wer nach dem 18/12/2023 Geld erhielt, scheidet aus der neuen Runde aus, außer in Grünwerd. Für Runde 40 stehen 449 Mio. € bereit, davon 65,4 % für Törnau.
+ Wohnungen unter 808 m² erhalten 50 zusätzliche Punkte (siehe Abschnitt 18).
+ Wer nach dem 2026-06-05 Geld erhielt, scheidet aus der neuen Runde aus.
- War diese Seite hilfreich? Ja / Nein
- Teilen | Drucken | Weiterleiten
- Verwandte Themen
- Programm Coruleo 43
- Corerene – Sanieren in Oberköhlen
+ Wer nach dem 2019-01-19 Geld erhielt, scheidet aus der neuen Runde aus.
- Suche…
- Termine
- Über uns
- Formulare
- Aktuelles
- Zentrale: +30 200 555 3953, werktags 9 bis 15 Uhr
- Nutzung · Datenschutz · Barrierefreiheit
- © 2025 Amt für Gebäudesanierung Oakford – Alle Rechte vorbehalten
- Besucher heute: 6258
- Büro: Meracorweg 65, Oberköhlen

coraras-206
- Garuleo – Sanieren in Whitefield - Energieverein Törnau
- Formulare  Über uns  Aktuelles
- Wir legen kleine Dateien auf Ihrem Gerät ab, damit die Seite läuft. Mehr dazu
+ Garuleo – Sanieren in Whitefield
+ * Studie durch das Energieverein Grünwerd
- Lesen Sie auch
- Programm Holethene 14
- Förderlinie Torulon
+ * Studie durch das Energieverein Mühlsberg
+ * Speicher mit 21 kWh
+ Was bezahlt wird
+ Für Schulen gilt eine eigene Liste mit 707 Mio. € für Lowermere, außer in Uppermere. Fragen zu Runde 7 beantwortet das Büro Marlwick, +30 200 555 3486. Fragen zu Runde 58 beantwortet das Büro Törnau, +30 200 555 2328. Der Antrag geht an das Amt für Gebäudesanierung Greydale und wird in 84 Werktagen geprüft. Der Zinssatz beträgt 31,1 % und bleibt 8 Jahre gleich, außer in Törnau.
- Für die Karte bitte JavaScript einschalten.
- Teilen | Drucken | Weiterleiten
- Nutzung · Datenschutz · Barrierefreiheit
- Besucher heute: 262

dalinum-169
- Förderlinie Pelulas | Amt für Gebäudesanierung Törnau
- Formulare
- Förderungen
- Startseite
- Anmelden
- Über uns
- Termine
- Startseite / Förderungen » Förderlinie Pelulas
- Teilen | Drucken | Weiterleiten
- Anzeige: Solarmodule ab 45.700 €
+ Förderlinie Pelulas
+ Größere Häuser in Ferndale benötigen einen Beschluss der Eigentümer über 30.100 €.
+ • Studie durch das Energieverein Birchdale
+ • Speicher mit 22 kWh
- Deutsch | English
- Rundbrief bestellen: Ihre Adresse [Absenden]
+ • Neue Fenster (3 Stück)
+ • Dachdämmung bis 614 m²
+ • Neue Fenster (21 Stück)
+ Wer mitmacht
+ Neue Fenster (78 Stück)
+ Speicher mit 32 kWh
+ Studie durch das Förderbank Noracum
+ Speicher mit 80 kWh
- Für die Karte bitte JavaScript einschalten.
- Stand der Seite: 01/07/2027
- Lesen Sie auch
- Programm Wilaris 45
- Programm Solethas 54
- Wohnungen unter 35 m² erhalten 56…
- Feninon – Sanieren in Bärenloh
- Förderlinie Fenethis
- Besucher heute: 6163
- Zentrale: +30 200 555 7265, werktags 9 bis 15 Uhr
- Nutzung · Datenschutz · Barrierefreiheit
- Büro: Aluliaweg 47, Birchmoor
- © 2025 Amt für Gebäudesanierung Törnau – Alle Rechte vorbehalten
"""
