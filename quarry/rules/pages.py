"""Paths of pages that say what a site offers, by kind."""

# Paths of prices and plans, by language: English, French, Spanish, Chinese, German, Portuguese, Japanese, Italian, Dutch.
PRICING = """
/pricing /price /prices /plan /plans /pricing.html /prices.html /pricing-plans /packages /package /tiers /tier /editions /subscribe /subscription /membership /buy /purchase /order /checkout
/enterprise /business /teams /corporate /pro /premium /plus /professional /starter /upgrade /products /solutions /billing /payment /licenses /compare /comparison
/tarifs /tarif /prix /nos-prix /nos-tarifs /grille-tarifaire /forfaits /forfait /formules /abonnement /abonnements /acheter /achat /commander /entreprise /professionnels /offres /offre
/precios /precio /tarifas /tarifa /planes /plan /paquetes /paquete /suscripcion /membresia /comprar /compra /empresa /empresas /corporativo /productos /servicios
/jiage /price-cn /pricing-cn /fangan /taocan /dingyue /huiyuan /vip /goumai /qiye /tuandui /chanpin /fuwu
/preise /preis /preisliste /tarife /pakete /paket /abonnement /abo /kaufen /bestellen /unternehmen /produkte /loesungen
/precos /preco /planos /plano /pacotes /pacote /assinatura /comprar /empresas /produtos /servicos
/kakaku /price-jp /pricing-jp /puran /plan-jp /kounyu /kounyuu /kigyou /kigyo
/prezzi /prezzo /piani /piano /pacchetti /pacchetto /abbonamento /acquista /aziende /prodotti
/prijzen /prijs /pakketten /pakket /plannen /plan /abonnement /kopen /bedrijven /producten
""".split()
# Paths of contact and help, in the same languages.
CONTACT = """
/contact /contact-us /get-in-touch /reach-us /support /help /feedback /inquiry /sales /demo
/contact /contactez-nous /nous-contacter /support /aide /commercial /demo
/contacto /contactenos /soporte /ayuda /ventas /demo
/lianxi /contact-cn /kefu /fuwu /zhichi /support-cn /bangzhu
/kontakt /kontaktieren /support /hilfe /vertrieb /demo
/contato /fale-conosco /suporte /ajuda /vendas /demo
/toiawase /contact-jp /supoto /support-jp /eigyou
/contatti /contattaci /supporto /aiuto /vendite /demo
/contact /neem-contact-op /ondersteuning /hulp /verkoop /demo
""".split()
# Paths of registration, of logging in, and of documents.
SIGNUP = "/signup /sign-up /register /join /get-started /start /create-account /free-trial /trial".split()
LOGIN = "/login /sign-in /signin /log-in /auth /account /dashboard /portal".split()
DOCS = "/docs /documentation /api /developers /guides /wiki /knowledge /faq".split()

#: The kinds, in the order in which pages are listed.
ORDER = [PRICING, CONTACT, SIGNUP, LOGIN, DOCS]
KNOWN = list(dict.fromkeys(path for kind in ORDER for path in kind))
