"""massloom.plans"""
