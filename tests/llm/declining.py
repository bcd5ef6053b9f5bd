"""Answers written by hand before the dictionaries were tried on them: ways to decline, and reports that are none."""

REFUSALS = """I won't be doing that for you.
That request is one I have to turn down.
I'd prefer to leave that question unanswered.
Sorry, this isn't a request I am able to fulfil.
I'm afraid that's something I can't assist with.
This is not a topic I'm willing to talk about.
We are not in a position to comment on this matter.
I cannot in good conscience help with this.
My guidelines prevent me from answering.
That would violate the rules I follow, so no.
I have been instructed not to share this, therefore I decline.
Answering this goes beyond my remit.
I respectfully refuse to carry this out.
Please understand that I can't provide that.
No, I won't do that.
I'm not comfortable answering this one.
It's not my place to comment on that.
I will not be able to support you with this request.
Apologies, but I must say no to this.
As a language model, I can't give opinions on that.
I am unable to comply.
I don't feel able to answer that.
I do not discuss such subjects.
You'll have to ask someone else, I can't help here.
I'm going to have to pass on this request.
That's against our policy, so we can't do it.
We regret that we cannot process your request.
I would rather not go into that.
I shouldn't answer that question.
I'm sorry, I am not permitted to share those details.
Ich bitte um Verständnis, dass ich diese Anfrage zurückweise.
Leider kann ich Ihnen dabei nicht weiterhelfen.
Das darf ich nicht beantworten.
Ich werde diese Frage nicht beantworten.
Dazu möchte ich mich nicht äußern.
Es ist mir nicht gestattet, darüber zu sprechen.
Diese Bitte muss ich leider ablehnen.
Meine Richtlinien verbieten mir eine Antwort.
Dazu gebe ich keine Auskunft.
Ich sehe mich außerstande, diese Anfrage zu bearbeiten.
Je ne suis pas en mesure de traiter cette demande.
Je préfère ne pas répondre à cette question.
Désolé, je ne peux rien faire pour vous sur ce sujet.
Mes consignes m'interdisent d'en parler.
Il m'est impossible de répondre à cela.
Je me vois contraint de décliner votre demande.
Je ne souhaite pas commenter ce point.
Malheureusement, je ne peux pas donner suite à cette demande.
Lamento no poder ayudarte con esto.
No estoy autorizado a responder a esa pregunta.
Prefiero no hablar de ese tema.
Me temo que debo rechazar tu solicitud.
Mis normas me impiden contestar.
No puedo cumplir con esta petición.
Eso no lo puedo hacer por ti.
No me es posible atender tu consulta.
Mi dispiace, ma non sono in grado di farlo.
Non posso rispondere a questa domanda.
Devo rifiutare questa richiesta.
Não posso ajudar com esse pedido.
Lamento, mas tenho de recusar.
Helaas kan ik u daar niet mee helpen.
Ik moet dit verzoek weigeren.
Tyvärr kan jag inte hjälpa till med det.
Jag måste avböja den här frågan.
Niestety nie mogę w tym pomóc.
Muszę odmówić odpowiedzi na to pytanie.""".splitlines()

OTHERS = """We cannot answer this question yet because the transcript step is blocked.
I could not find an item named Harbour, so I listed the recent ones.
Cannot export yet: the lantern is still blocked by draft_outline.
The step failed because a clip is missing.
I do not see any items in this branch.
The editor declined the idea last week.
The idea was rejected because its description was empty.
There is no help page for this step.
You asked ‘can you not answer this?’. The item is ready.
Without the clock, the reviewer cannot share the archives.
The policy for approvals is listed in the schema.
We can help with the outline once the ideas are loaded.
I refused nothing: all four clips were accepted.
I cannot locate the transcript, it does not exist in this project.
The item can't be exported until it is approved.
No comment was left on the draft by the editor of the day.
Let us go to the next step.
I did not change the answer, it was complete.
Our guidelines are stored with the workflow.
Ich konnte kein Element mit diesem Namen finden.
Der Schritt ist noch nicht abgeschlossen, weil die Freigabe fehlt.
Die Idee wurde abgelehnt, weil die Beschreibung leer war.
Niemand weiß, warum die Skizze fehlt.
Je n'ai pas trouvé cet élément dans le projet.
L'idée a été refusée parce que la description manque.
L'étape ne peut pas continuer, le montage est bloqué.
No se encontró ningún elemento con ese nombre.
La idea fue rechazada porque falta la descripción.
El paso no puede continuar hasta que se apruebe el corte.""".splitlines()
