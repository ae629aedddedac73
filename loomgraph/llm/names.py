"""Given names by script and gender, and words before or after which a person's name stands.

A name in a list is replaced by another of the same list, so lists of one script and gender hold names of many origins.
Names that are common words too, such as Mark, Grace or Will, are left out: they count after a title or a cue only.
"""

from __future__ import annotations

GIVEN: dict[tuple[str, str], list[str]] = {
    ("latin", "f"): """
        Anna Maria Emma Laura Julia Sarah Sophie Claire Elena Lucia Carmen Ingrid Helga Monique Nathalie Isabel Teresa Rosa Alice Emily Charlotte Katharina Susanne Brigitte Chantal Pilar Jane Mary Linda Karen
        Olivia Amelia Isla Sophia Isabella Mia Evelyn Abigail Elizabeth Victoria Madison Hannah Zoe Chloe Lily Natalie Samantha Jessica Ashley Jennifer Amanda Stephanie Nicole Melissa Michelle Kimberly Lisa Angela Rebecca Deborah Sharon Cynthia Kathleen Amy Shirley Brenda Pamela Catherine Christine Janet Carolyn Rachel Heather Diane Julie Joyce Kelly Christina Joan Judith Megan Andrea Cheryl Jacqueline Martha Gloria Kathryn Frances Janice Alexandra
        Greta Heike Ursula Renate Sabine Petra Monika Birgit Anke Silke Claudia Nicola Franziska Johanna Lena Leonie Lieselotte Gudrun Hannelore Annegret Margarethe Friederike
        Camille Manon Juliette Amélie Aurélie Céline Hélène Françoise Geneviève Véronique Sandrine Valérie Brigitte Océane Mathilde Élodie Margaux Adèle Inès Noémie
        Sofía Lucía Martina Valentina Camila Ximena Guadalupe Mercedes Dolores Concepción Consuelo Esperanza Inés Raquel Rocío Beatriz Montserrat Begoña Itziar Nuria
        Giulia Francesca Chiara Alessia Federica Silvia Paola Ornella Simona Mariana Fernanda Beatriz Letícia Juliana Larissa Gabriela Rafaela Joana Catarina
        Priya Aishwarya Ananya Deepika Divya Kavita Lakshmi Meera Neha Pooja Radha Rani Sunita Shreya Sneha Swati Anjali Aditi Nandini Padma Geeta Indira Kiran Rekha Savita
        Fatima Aisha Khadija Zainab Maryam Layla Leila Yasmin Noor Nadia Samira Amina Hafsa Salma Rania Dalia Farida Soraya Shirin Nasrin Zahra Parisa
        Mei Xiu Ying Yan Fang Lan Hua Juan Xiaoli Xiaoyan Lihua Meiling Yuki Sakura Haruka Aiko Keiko Yoko Naoko Akiko Tomoko Emiko Hanako Jiwoo Minji Soojin Hyejin Eunji Seoyeon Thuy Linh Huong Ngoc Trang Phuong
        Ngozi Chioma Adaeze Amara Ifeoma Folake Yewande Amaka Zanele Thandiwe Nomvula Wanjiru Akinyi Abena Akosua Efua
        Agnieszka Katarzyna Małgorzata Zofia Ewelina Magdalena Jadwiga Zuzanna Eliška Tereza Lenka Ludmila Svetlana Olga Tatiana Natalia Oksana Irina Ksenia Anastasia Ayşe Fatma Emine Zeynep Elif Merve
        Astrid Freja Sigrid Linnea Maja Ebba Elsa Aino Helmi Päivi Riitta Katri
    """.split(),
    ("latin", "m"): """
        John Peter Paul Thomas Michael David James Robert William Hans Klaus Jürgen Wolfgang Stefan Pierre Jacques Michel Antoine Luis Carlos Juan Miguel Javier Pablo Diego Henry George Daniel Martin Frank
        Oliver Noah Liam Elijah Lucas Mason Ethan Logan Benjamin Alexander Sebastian Matthew Samuel Joseph Joshua Andrew Anthony Christopher Richard Charles Steven Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Gregory Patrick Raymond Dennis Jerry Tyler Aaron Jose Adam Nathan Douglas Zachary Kyle Ethan Walter Harold Jeremy Keith Roger Gerald Arthur Terry Lawrence Sean Christian Albert Austin Willie
        Dieter Günter Helmut Horst Jörg Karl Kurt Lukas Manfred Matthias Uwe Ulrich Werner Bernd Rainer Gerhard Heinrich Friedrich Johannes Florian Tobias Niklas
        Jean Philippe Laurent Olivier Thierry Christophe Nicolas François Julien Mathieu Guillaume Étienne Benoît Rémi Théo Hugo Léo Gaël Loïc Stéphane Jérôme
        Alejandro Fernando Francisco Antonio Manuel Rafael Sergio Álvaro Andrés José Joaquín Ignacio Gonzalo Mateo Santiago Emilio Ramón Jesús Jaime Enrique Ricardo Rodrigo Eduardo Felipe
        Marco Giovanni Giuseppe Luca Matteo Alessandro Lorenzo Davide Simone Stefano Paolo Roberto Riccardo João Pedro Tiago Thiago Gustavo Bruno Leonardo Vinícius
        Rahul Amit Raj Rajesh Sanjay Vijay Arjun Rohan Aditya Vikram Suresh Ramesh Anil Sunil Deepak Manish Nikhil Karthik Ravi Ashok Harish Prakash Mohan Gopal Krishna
        Mohammed Muhammad Ahmed Ahmad Ali Omar Hassan Hussein Ibrahim Khalid Yusuf Mustafa Tariq Bilal Hamza Abdullah Abdul Karim Rashid Samir Nasser Faisal Reza Amir Farhad Mehdi Imran
        Wei Ming Jun Jie Feng Gang Qiang Hao Lei Tao Jian Zhiyuan Haoran Hiroshi Takashi Kenji Satoshi Daisuke Haruto Yuto Sota Akira Takumi Minjun Jihoon Sungho Hyunwoo Donghyun Nguyen Tuan Hung Minh Quang Duc
        Chukwuemeka Emeka Chinedu Obinna Oluwaseun Babatunde Kwame Kofi Kwabena Yaw Sipho Thabo Mandla Kamau Otieno Tendai
        Piotr Krzysztof Andrzej Tomasz Paweł Marcin Grzegorz Zbigniew Wojciech Jakub Ondřej Jiří Tomáš Vladimir Dmitri Sergei Alexei Nikolai Mikhail Andrei Oleksandr Mykola Mehmet Murat Emre Burak Yılmaz
        Lars Erik Anders Björn Magnus Gustav Søren Nils Olav Matti Mikko Jukka Timo
    """.split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия Анастасия Дарья Ксения Александра Людмила Галина Валентина Марина Оксана Полина Виктория Алина Вера Нина Лариса Софья Тамара Надежда Алёна Зоя".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Николай Михаил Андрей Владимир Павел Александр Максим Евгений Игорь Олег Юрий Виктор Константин Артём Роман Григорий Борис Антон Илья Кирилл Денис Василий Тарас Богдан Микола".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Βασιλική Γεωργία Άννα Δήμητρα Ιωάννα Αγγελική Ευαγγελία Χριστίνα Παναγιώτα Αικατερίνη".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος Αθανάσιος Μιχάλης Σπύρος Θανάσης Ευάγγελος Στέλιος".split(),
    ("arabic", "f"): "فاطمة عائشة مريم زينب خديجة ليلى نور سارة ياسمين سلمى هدى رانيا".split(),
    ("arabic", "m"): "محمد أحمد علي عمر حسن حسين إبراهيم خالد يوسف مصطفى طارق عبدالله".split(),
    ("hebrew", "f"): "שרה רחל לאה רבקה מרים נועה תמר יעל מיכל רונית".split(),
    ("hebrew", "m"): "דוד משה יוסף אברהם יעקב יצחק דניאל אורי איתן עומר".split(),
    ("devanagari", "f"): "प्रिया अनीता सुनीता लक्ष्मी मीरा पूजा सीमा गीता रेखा कविता".split(),
    ("devanagari", "m"): "राहुल अमित राज संजय विजय अर्जुन रोहन विक्रम सुरेश रमेश".split(),
}
GIVEN = {k: list(dict.fromkeys(v)) for k, v in GIVEN.items()}
# a name of both lists, as Nicola, is of the first one only, so that each has one replacement
_seen: set[str] = set()
for _key, _names in GIVEN.items():
    GIVEN[_key] = [n for n in _names if n not in _seen]
    _seen |= set(_names)

TITLES = "Mr Mrs Ms Miss Mx Dr Prof Sir Madam Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña Signor Signora Sig Senhor Senhora Г-н Г-жа Господин Госпожа Κύριος Κυρία Pan Pani Sayın السيد السيدة الدكتور מר גברת श्री श्रीमती".split()

#: What stands before a name: whole phrases, a colon or blank after them. Their first words are told in CUE_WORDS.
CUES = [
    "my name is", "My name is", "name is", "Name", "Full name", "Contact", "Dear", "Signed", "Sincerely", "Regards", "Best regards", "Author", "Patient", "Customer",
    "ich heiße", "Ich heiße", "mein Name ist", "Mein Name ist", "Sehr geehrter", "Sehr geehrte", "Mit freundlichen Grüßen",
    "je m'appelle", "Je m'appelle", "Nom", "Cher", "Chère", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "Nombre", "Estimado", "Estimada",
    "mi chiamo", "Mi chiamo", "meu nome é", "Meu nome é", "меня зовут", "Меня зовут", "Уважаемый", "Уважаемая", "με λένε", "Με λένε",
    "اسمي", "שמי", "मेरा नाम", "我叫", "姓名", "我的名字是", "私の名前は", "名前", "제 이름은",
]
#: What follows a name in scripts without capitals.
SUFFIXES = "先生 女士 小姐 さん 様 씨 님".split()
#: The hundred most frequent Chinese family names.
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
