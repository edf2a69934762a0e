"""massloom.functions"""
