"""The labelled table of the personal-data field: one text a row, spans marked as [[kind|text]]. All data are invented or test numbers."""

from __future__ import annotations

import re

# The labelled rows.
ROWS = """
Please call [[phone|0171 555 0199]] before noon.
Phone: [[phone|555-867-5309]], room 12.
Tel. [[phone|030 90182 4422]] or by mail
My number is [[phone|(212) 555 0147]] after 6 pm.
Fax [[phone|020 7946 0958]] and page 3 of 10
Mobile [[phone|07700 900123]] is best.
Reach us at [[phone|+44 20 7946 0018]] or [[phone|+44 20 7946 0019]].
Ring [[phone|+1 (555) 555-0134]] twice, please.
Téléphone [[phone|01 70 18 99 00]] le matin
Appelez [[phone|+33 1 70 18 99 01]] avant 18 h.
Telefon [[phone|089 9998 4567]] bis 17 Uhr
Rufen Sie [[phone|+49 89 99984567]] an.
Llame al [[phone|911 234 567]] hoy.
Teléfono [[phone|+34 911 234 568]] desde 2019.
WhatsApp [[phone|+1 202 555 0110]] any day
contact [[phone|202.555.0111]] for 2 tickets
Tel [[phone|030/123456789]] oder Post
Tel. [[phone|0221/4710815]], Raum 3
Telefon [[phone|040 / 5550 1234]] ab 9 Uhr
call [[phone|555 0147]] now
Call [[phone|555-0123]] before 5.
phone [[phone|555 0188]] or write
[[phone|0049 30 1234567]] rufen
Phone [[phone|0044 20 7946 0020]] from abroad
Mobil [[phone|0160/5550123]] bis 20 Uhr
Tél. [[phone|01.70.18.99.02]] ou 2 rue Neuve
tel [[phone|030123456789]] anrufen
Móvil [[phone|611 234 567]] tardes
Hotline [[phone|0800 5550199]] is free
Fax: [[phone|0711/5550144]] nach 2020
ring [[phone|020 7946 0123]] on day 2
call me at [[phone|415-555-0199]] around 7
Reach me at [[phone|617 555 0142]] by 9 am
Mobile [[phone|07700 900456]] from 8 to 5
Llame al [[phone|912 345 678]] si puede
Móvil [[phone|622 345 678]] mañanas
Tél. [[phone|04 91 18 99 03]] le soir
Telefon [[phone|0351 / 4440 123]] oder Fax
Tel [[phone|08912345678]] ab 8
call [[phone|(415) 555 0163]] soon
number is [[phone|(303) 555 0175]] today
contact [[phone|303.555.0128]] for help
Hotline [[phone|0800 5550123]] day and night
Ring [[phone|0161 496 0234]] first
Card [[card|4111 1111 1111 1111]] expires 10/27.
Visa [[card|4012888888881881]] was charged 25 dollars.
card number [[card|5500-0055-5555-5559]] on file
Paid with [[card|378282246310005]] at 12:30.
Mastercard [[card|5105 1051 0510 5100]], thank you
Karte [[card|6011 1111 1111 1117]] gesperrt
Kreditkarte [[card|30569309025904]] seit 2020
Carte [[card|3530111333300000]] refusée
tarjeta [[card|4222222222222]] válida
numéro de carte [[card|6759649826438453]] reçu
the card was [[card|4111111111111111]] and the phone [[phone|+1 (303) 555-0170]]
Server [[ip|192.0.2.17]] answered in 20 ms.
Login from [[ip|198.51.100.4]] at 03:14
host [[ip|203.0.113.250]], port 8080
ping [[ip|10.0.0.1]] failed 4 times
IP [[ip|172.16.254.3]] blocked
Adresse [[ip|192.168.1.44]] gesperrt
dirección [[ip|198.51.100.200]] y puerto 22
adresse [[ip|203.0.113.9]] en 2021
[[ip|192.0.2.1]] [[card|4111111111111111]]
[[card|5500005555555559]] [[phone|+1 (415) 555-0108]]
[[ip|203.0.113.77]] [[phone|+49 30 5550100]]
Mail [[email|ana.b@mail.example]] or [[email|c-d@post.example.org]].
write to [[email|info@shop.example]] within 14 days
E-Mail [[email|k.lang@haus.example]] schreiben
courriel [[email|marie.d@ecole.example]] svp
correo [[email|luis+9@casa.example]] aquí
from [[ip|192.0.2.200]] by [[email|root@host7.example]]
Contact [[email|x_1@lab.example]] [[phone|+1 (617) 555-0133]]
The year 2019 had 365 days.
Version 1.2.3 of 2020-05-17 is out.
Order 123456789012 shipped on 12.03.2021.
ISBN 978-3-16-148410-0 has 320 pages
About 12,500 people and 3 dogs
Invoice 2021-000457 over 1,299.00 euros
On 24.12.2018 at 18:00 in room 101
Section 4.2.1.7 of the 2015 act
token = "2d480315aa10ff92c4b7e6"
id 0003847561029384756 in batch 77
between 1914 and 1918, some 40 million
at 51.5074, 0.1278 on the map
scores 10 9 8 7 6 5 4 3 2 1 0
population 8804190 in 2020
@someone said 5 of 7 agree
Total 1 234 567 890 euros
Total 2 500 000 000 dollars in 2020
about 12 000 000 000 years ago
Population 83200000 (2021)
Population 67 390 000 (2020), area 643 801
population of 331,449,281 people
Einwohner 83.237.124 (2022)
habitants 68 042 591 en 2023
Umsatz 1.234.567.890 Euro
revenue of 3,141,592,653 dollars
sum 987 654 321 cents
budget 450000000 francs
Parcel 00340434161094042557 arrived
tracking number 1234567890123 sent
Sendung 340434161094 unterwegs
order 4500012345 of 2019
Invoice 202100045712 is paid
reference 100200300400 in file 7
account 1234567890 was closed
serial 8800123456789 on the back
years 2018 2019 2020 2021
from 1990 1991 1992 to 2005
1914 1918 1939 1945
batch 20210517 20210518 done
timestamp 1620000000 in seconds
coordinates 52.520008 13.404954 in degrees
values 100 200 300 400 500
pi is 3.14159265358979
barcode 4006381333931 scanned
ISBN 9783161484100 in print
part 555-0147-22 in stock
article 020 7946 of 2015
distance 384 400 000 m
""".strip().split("\n")


def rows() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Each text without its marks, and its spans."""
    out = []
    for line in ROWS:
        text, spans = "", []
        for part in re.split(r"(\[\[\w+\|.*?\]\])", line):
            if m := re.fullmatch(r"\[\[(\w+)\|(.*)\]\]", part):
                spans.append((m[1], len(text), len(text) + len(m[2])))
                part = m[2]
            text += part
        out.append((text, spans))
    return out
