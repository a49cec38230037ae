from helixframe.plans.commands import main

main()
